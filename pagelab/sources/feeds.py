"""URL feeds: ranked domain lists, JSON threat feeds, plain text feeds.

Network fetching is out of scope; feeds are DataFrames (read from files or
derived from tables) and every step below is a DataFrame operation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANK_SCHEMA = T.StructType([T.StructField("rank", T.LongType()), T.StructField("domain", T.StringType())])
FEED_JSON_SCHEMA = T.StructType([T.StructField("url", T.StringType()),
                                 T.StructField("online", T.StringType()),
                                 T.StructField("verified", T.StringType())])


def read_rank_list(spark, path: str) -> DataFrame:
    """Headerless ``rank,domain`` CSV with a declared schema (no inference)."""
    return spark.read.schema(RANK_SCHEMA).csv(path)


def feed_rank_list(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """``https://`` + domain in rank order (top ``limit``)."""
    out = ranked.select("rank", "domain", F.concat(F.lit("https://"), F.col("domain").cast("string")).alias("url"))
    out = out.orderBy("rank")
    return out.limit(limit) if limit else out


def anti_join_existing(candidates: DataFrame, existing: DataFrame, key: str = "url",
                       order: str = "rank", limit: int | None = None) -> DataFrame:
    """Candidates whose key is not already collected, first N in feed order.

    ``left_anti`` lets Spark pick a broadcast or a shuffled hash/sort-merge
    anti join by the measured size of ``existing``; ``orderBy().limit()``
    plans as a top-k (TakeOrderedAndProject), not a full sort.
    """
    # an anti join needs no unique keys on the existing side: no extra distinct
    out = candidates.join(existing.select(key), key, "left_anti")
    return out.orderBy(order).limit(limit) if limit else out


def parse_json_feed(raw: DataFrame, col: str = "value") -> DataFrame:
    """JSON documents (one per row) -> url, online, verified."""
    return raw.select("*", F.from_json(F.col(col), FEED_JSON_SCHEMA).alias("_j")).select("*", "_j.*").drop("_j")


def feed_json_verified(items: DataFrame) -> DataFrame:
    """Keep entries that are online and verified."""
    return items.where((F.col("online") == "yes") & (F.col("verified") == "yes"))


def feed_text_lines(lines: DataFrame, existing: DataFrame | None = None, col: str = "line",
                    existing_col: str = "line") -> DataFrame:
    """A10: trim, drop empty lines, drop lines already known."""
    out = lines.withColumn(col, F.trim(F.col(col))).where(F.col(col) != "")
    if existing is not None:
        known = existing.select(F.trim(F.col(existing_col)).alias(col))
        out = out.join(known, col, "left_anti")
    return out


def feed_fallback(*feeds: DataFrame) -> DataFrame:
    """Rows of the first feed that yields anything; later feeds only
    when all earlier ones are empty. One pass: tag priorities, take the
    minimum priority present (a one-row aggregate joined back)."""
    tagged = None
    for i, f in enumerate(feeds):
        t = f.withColumn("_prio", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    best = tagged.agg(F.min("_prio").alias("_prio"))
    return tagged.join(F.broadcast(best), "_prio", "left_semi").drop("_prio")


def text_lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Split whole texts into numbered lines (narrow: explode inside the row)."""
    return docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
