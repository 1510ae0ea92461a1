"""Validity filter, append with de-duplication, cleaning funnel,
verification counts and class distribution.

De-duplication "keep first" is an aggregate of fixed-width numbers per key
(smallest id, length and flags of that row), combined on the map side: a key
that holds a third of all rows is reduced before the shuffle, and page texts
are measured in the scan and stay there. Where rows must come out whole, the
kept ids are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelab.functions.html import CONTROL_CHARS_RE, error_page_flag, strip_ws


def page_validity_filter(df: DataFrame, html: str = "html", min_len: int = 100) -> DataFrame:
    """Keep pages whose stripped HTML is longer than ``min_len``; remove
    control characters."""
    return (df.where(F.length(strip_ws(F.col(html))) > min_len)
              .withColumn(html, F.regexp_replace(F.col(html), CONTROL_CHARS_RE, "")))


def first_ids(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, id) of the first row of each key. One number per key: a hash
    aggregate, combined before the shuffle, without any other column."""
    return df.groupBy(key).agg(F.min(id_col).alias(id_col))


def keep_first(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """The row of smallest ``id_col`` (unique) of each ``key``."""
    return df.join(first_ids(df, key, id_col), [key, id_col], "left_semi").select(*df.columns)


def append_dedup(old: DataFrame, new: DataFrame, key: str = "url", id_col: str = "page_id") -> DataFrame:
    """Union old + new, one row per URL, the old row wins (then the smallest
    id; ids are unique within each side)."""
    u = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    best = u.groupBy(key).agg(F.min(F.when(~F.col("_new"), F.col(id_col))).alias("_a"),
                              F.min(F.when(F.col("_new"), F.col(id_col))).alias("_b"))
    best = best.select(F.col(key).alias("_k"), F.coalesce("_a", "_b").alias("_i"), F.col("_a").isNull().alias("_n"))
    return (u.join(best, (F.col(key) == F.col("_k")) & (F.col(id_col) == F.col("_i")) & (F.col("_new") == F.col("_n")), "left_semi")
             .drop("_new"))


def _checked(df: DataFrame, html: str, min_len: int, keep: list[str]) -> DataFrame:
    """``keep`` columns with what cleaning asks of the page text, computed in the scan."""
    whole = None
    for c in df.columns:
        whole = F.col(c).isNotNull() if whole is None else whole & F.col(c).isNotNull()
    return df.select(*keep, whole.alias("_whole"), F.length(html).alias("html_length"),
                     (F.length(html) > min_len).alias("_long"), error_page_flag(F.col(html)).alias("_error"))


def clean_keys(df: DataFrame, url: str = "url", html: str = "html", id_col: str = "page_id",
               min_len: int = 150) -> DataFrame:
    """A14 without the texts: (url, id, html_length) of the rows that cleaning keeps.
    The page text is measured in the scan and never shuffled."""
    x = _checked(df, html, min_len, [url, id_col]).where("_whole")
    first = x.groupBy(url).agg(F.min(id_col).alias(id_col), F.min_by("html_length", id_col).alias("html_length"),
                               F.min_by("_long", id_col).alias("_long"), F.min_by("_error", id_col).alias("_error"))
    return first.where("_long AND NOT _error").select(url, id_col, "html_length")


def clean_pages(df: DataFrame, url: str = "url", html: str = "html", id_col: str = "page_id",
                min_len: int = 150) -> DataFrame:
    """Drop NULLs -> keep first row per URL -> HTML longer than
    ``min_len`` -> drop short (< 2000) pages with a server-error signature.
    Rows (unique by id) come back by a semi join with the kept ids."""
    kept = clean_keys(df, url, html, id_col, min_len).select(id_col)
    return df.dropna(subset=list(df.columns)).join(kept, id_col, "left_semi").select(*df.columns)


def clean_funnel(df: DataFrame, url: str = "url", html: str = "html", id_col: str = "page_id",
                 min_len: int = 150) -> DataFrame:
    """Rows left after each cleaning step, and rows removed in total."""
    x = _checked(df, html, min_len, [url, id_col])
    firsts = x.where("_whole").groupBy(url).agg(F.min_by("_long", id_col).alias("_long"),
                                                F.min_by("_error", id_col).alias("_error"))
    # two one-row aggregates: one over the input, one over the first row per URL
    before = x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_whole").cast("long")).alias("nonnull"))
    after = firsts.agg(F.count(F.lit(1)).alias("dedup"),
                       F.sum(F.col("_long").cast("int")).alias("short"),
                       F.sum((F.col("_long") & ~F.col("_error")).cast("int")).alias("errors"))
    one = before.join(after, how="inner")  # one row x one row

    def step(no, name, col):
        return F.struct(F.lit(no).alias("step_no"), F.lit(name).alias("step"),
                        F.coalesce(col, F.lit(0)).cast("long").alias("rows"))
    steps = F.array(step(0, "initial", F.col("n")), step(1, "drop_nulls", F.col("nonnull")),
                    step(2, "dedup_url", F.col("dedup")), step(3, "drop_short_html", F.col("short")),
                    step(4, "drop_error_pages", F.col("errors")))
    return one.select(F.col("n"), F.explode(steps).alias("s")).select(
        "s.step_no", "s.step", "s.rows", (F.col("n") - F.col("s.rows")).alias("removed"))


def verify_dataset(df: DataFrame, url: str = "url", html: str = "html", cat: str = "category",
                   expected_rows: int | None = None) -> DataFrame:
    """Counts, NULL counts, empty-after-trim counts, duplicate URLs."""
    n = F.count(F.lit(1))
    out = df.agg(
        n.alias("rows"),
        F.sum(F.col(url).isNull().cast("int")).alias("null_url"),
        F.sum(F.col(html).isNull().cast("int")).alias("null_html"),
        F.sum(F.col(cat).isNull().cast("int")).alias("null_category"),
        F.sum((strip_ws(F.col(url)) == "").cast("int")).alias("empty_url"),
        F.sum((strip_ws(F.col(html)) == "").cast("int")).alias("empty_html"),
        (n - F.countDistinct(url)).alias("duplicate_urls"),
    )
    if expected_rows is not None:
        out = out.withColumn("rows_match", F.col("rows") == F.lit(expected_rows))
    return out


def class_distribution(df: DataFrame, cat: str = "category") -> DataFrame:
    """Count and percentage per class (NULL is its own class)."""
    counts = df.groupBy(cat).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    return (counts.join(F.broadcast(total), how="inner")  # one-row side
                  .select(cat, "count", (F.col("count") * 100.0 / F.col("_total")).alias("percent")))
