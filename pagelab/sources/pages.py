"""Readers and sinks for page tables (parquet, CSV, JSON, text).

Readers accept the column-name variants seen in page collections (``Data`` /
``url`` for the URL, ``html`` / ``HTML`` / ``Data`` for the page,
``Category`` / ``Label`` / ``Class`` for the class) and return one schema:
``page_id long, url string, html string, category string``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelab.session import SCAN_PARTITIONS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

URL_ALIASES = ["url", "URL", "Data"]
HTML_ALIASES = ["html", "HTML", "html_content", "Data"]
CLASS_ALIASES = ["category", "Category", "Label", "label", "Class"]


# tables whose rows carry whole pages / texts: per-row CPU work is heavy
TEXT_TABLES = {"pages", "documents", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """One of the given parquet tables.

    A scan has one task per file split, and a file of one row group cannot be
    split. ``partitions``, or for text-heavy tables the session setting
    ``spark.pagelab.scanPartitions``, deals the rows to so many tasks; where
    neither is set (clusters) the scan stays as it is. The size of the data
    plays no part."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    n = partitions or (int(spark.conf.get(SCAN_PARTITIONS, "0")) if name in TEXT_TABLES else 0)
    return df.repartition(n) if n else df


def _first(df: DataFrame, names) -> str | None:
    for n in names:
        if n in df.columns:
            return n
    return None


def read_any(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    fmt = fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".") or "parquet"
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if fmt == "json":
        return r.json(path)
    if fmt in ("txt", "text"):
        return r.text(path)
    return r.parquet(path)


def normalize_page_columns(df: DataFrame, key: str = "page_id") -> DataFrame:
    """Rename URL / HTML / class variants to ``url``, ``html``, ``category``."""
    url_c = _first(df, URL_ALIASES)
    html_c = _first(df, [c for c in HTML_ALIASES if c != url_c])
    cls_c = _first(df, CLASS_ALIASES)
    cols = [F.col(key).cast("long").alias("page_id")] if key in df.columns else \
        [F.monotonically_increasing_id().alias("page_id")]
    cols.append(F.col(url_c).cast("string").alias("url") if url_c else F.lit(None).cast("string").alias("url"))
    cols.append(F.col(html_c).cast("string").alias("html") if html_c else F.lit(None).cast("string").alias("html"))
    cols.append(F.col(cls_c).cast("string").alias("category") if cls_c else F.lit(None).cast("string").alias("category"))
    return df.select(*cols)


def scan_pages(spark: SparkSession, url_path: str, html_path: str | None = None,
               key: str = "page_id") -> DataFrame:
    """A1/A2: load a page table; when URL and HTML live in two tables they are
    aligned by the page key (an inner equi-join, not row position)."""
    urls = normalize_page_columns(read_any(spark, url_path), key)
    if not html_path or html_path == url_path:
        return urls
    htmls = normalize_page_columns(read_any(spark, html_path), key).select("page_id", F.col("url").alias("_h"), "html")
    htmls = htmls.select("page_id", F.coalesce("html", "_h").alias("html"))
    return align_url_html(urls.drop("html"), htmls)


def align_url_html(urls: DataFrame, htmls: DataFrame, key: str = "page_id") -> DataFrame:
    """A2: attach the HTML to URL rows by key; rows without a partner drop."""
    return urls.join(htmls, key, "inner")


def inner_join_on_column(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """A3: plain inner equi-join of two tables on shared columns."""
    return left.join(right, on, "inner")


def union_tag_era(frames: dict[str, DataFrame], col: str = "era") -> DataFrame:
    """A4: concatenate tables and tag each row with its dataset name."""
    out = None
    for name, df in frames.items():
        t = df.withColumn(col, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None) -> None:
    """A6/A26 sink: parquet (default) or CSV with header."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
