"""Base tables shared by the registered queries.

``pages`` carries no class or era. The queries use documented surrogates
derived from the table itself (not subsets of it):

* ``label``    1 when the page's ``<html lang="...">`` is not ``en`` (surrogate class)
* ``era``      ``old`` for even ``page_id``, ``new`` for odd (surrogate crawl era)
* ``category`` raw class strings cycling through spam, ham, Phishing, benign,
               malware, NULL by ``page_id % 6`` (input of the label policies)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelab.sources.pages import table

LANG_RE = r"""<html[^>]*\slang="([^"]*)\""""
CATEGORY_CYCLE = ["spam", "ham", "Phishing", "benign", "malware", None]


def lang_of(html) -> "F.Column":
    h = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract(F.coalesce(h, F.lit("")), LANG_RE, 1)


def category_of(page_id) -> "F.Column":
    pid = F.col(page_id) if isinstance(page_id, str) else page_id
    c = F.lit(None).cast("string")
    out = None
    for i, v in enumerate(CATEGORY_CYCLE):
        val = F.lit(v) if v is not None else c
        out = F.when(pid % 6 == i, val) if out is None else out.when(pid % 6 == i, val)
    return out


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages + surrogate label, era and category."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id", "url", "html",
        (lang_of("html") != "en").cast("int").alias("label"),
        F.when(F.col("page_id") % 2 == 0, "old").otherwise("new").alias("era"),
        category_of("page_id").alias("category"),
    )
