"""Training-data operators: decontamination, token counts, archives, licence
scans, language-model scores, near-duplicates, mixing, URL filters, main-text
extraction and quality rules.

Nothing outside this package imports it. Every operator takes and returns
DataFrames; ``pagelab.llm.queries`` registers one query per operator.
"""
