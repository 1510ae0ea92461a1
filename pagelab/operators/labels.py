"""A5: category string -> 0/1 label under the four policies of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the label policies
# ---------------------------------------------------------------------------
PIPELINE_MAP = {"ham": 0, "spam": 1, "benign": 0, "phishing": 1}
STANDARD_POSITIVE = ["phishing", "malware", "spam"]
STANDARD_NEGATIVE = ["benign", "ham"]
ISIN_POSITIVE = ["phishing", "malware", "spam"]
# ---------------------------------------------------------------------------


def label_standardise(cat) -> Column:
    """Case-folded; phishing/malware/spam -> 1; everything else incl. NULL -> 0."""
    c = F.lower(F.col(cat) if isinstance(cat, str) else cat)
    return F.when(c.isin(STANDARD_POSITIVE), 1).otherwise(0)


def label_contains(cat) -> Column:
    """Lower-cased and stripped; contains 'spam' -> 1, contains 'ham' -> 0, else NULL."""
    c = F.trim(F.lower(F.col(cat) if isinstance(cat, str) else cat))
    return F.when(c.contains("spam"), 1).when(c.contains("ham"), 0)


def label_isin(cat) -> Column:
    """Lower-cased value in {phishing, malware, spam} -> 1 else 0."""
    c = F.lower(F.col(cat) if isinstance(cat, str) else cat)
    return F.when(c.isin(ISIN_POSITIVE), 1).otherwise(0)


def label_pipeline_map(cat) -> Column:
    """Exact (case-sensitive) dictionary lookup; unmatched -> NULL."""
    c = F.col(cat) if isinstance(cat, str) else cat
    m = F.create_map(*[x for k, v in PIPELINE_MAP.items() for x in (F.lit(k), F.lit(v))])
    return m[c]


def map_label(df: DataFrame, policy: str, cat: str = "category", order: str = "page_id",
              out: str = "label") -> DataFrame:
    """Apply a label policy.

    ``pipeline`` maps only when the first row (by ``order``) holds a mapped
    string; otherwise the raw value passes through (cast to int). The first
    row is found with a one-row ``min_by`` aggregate, not a global sort.
    ``contains`` drops rows whose label stays NULL.
    """
    if policy == "standardise":
        return df.withColumn(out, label_standardise(cat))
    if policy == "isin":
        return df.withColumn(out, label_isin(cat))
    if policy == "contains":
        return df.withColumn(out, label_contains(cat)).where(F.col(out).isNotNull())
    if policy == "pipeline":
        # one scalar: is the first row's category a mapped string?
        first = df.agg(F.min_by(F.col(cat), F.col(order)).alias("_first")).first()["_first"]
        if first in PIPELINE_MAP:
            return df.withColumn(out, label_pipeline_map(cat))
        return df.withColumn(out, F.col(cat).cast("int"))
    raise ValueError(f"unknown label policy {policy!r}")
