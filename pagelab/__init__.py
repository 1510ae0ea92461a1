"""pagelab: Spark-native analytics for collections of crawled web pages.

Sub-packages
------------
sources    readers, feeds and sinks (DataFrame in / DataFrame out)
functions  column expressions over URL and HTML strings (JVM-side, no UDFs)
operators  DataFrame -> DataFrame operators: DOM events, TF-IDF, scaling,
           evaluation, drift, models, explanation
plans      query registry wired for ``__spark_entry__`` and its SQL oracle
streaming  Structured Streaming forms of ingestion and scoring
"""

__version__ = "0.1.0"
