"""Benchmark decontamination with DataFrame operations only.

Benchmark texts are cut into windows of ``width`` normalised words (a shorter
text is one window). The windows form a hash set that every task holds: a
broadcast join on the 64-bit hash of a window. Documents slide over their own
words; each hash match is verified word by word, and verified windows become
hit spans. Per document only (row, position, items) of hits are shuffled.

The set is broadcast while it holds at most ``max_broadcast`` windows (one
aggregate over the benchmark tells); a larger set is joined by a shuffle on
the hash with the same rows as result.

Defined cases: null or word-free documents have no words and no hits; null or
word-free items match nothing; an item with a null id still marks words but
has no name to list; repeated documents are judged row by row; repeated items
count once per item_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelab.llm.common import ALNUM_WORD, checkpointed, fresh_name, lower_az, word_array

#: The same words where A-Z has not been folded yet.
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_of(text: Column) -> Column:
    return word_array(lower_az(text), ALNUM_WORD)


def windows(bench: DataFrame, width: int = 10) -> DataFrame:
    """(gram, items): each distinct window with the sorted ids of its items."""
    w = bench.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    cut = w.select("item_id", "w", n.alias("n"),
                   F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("p"))
    return (cut.select("item_id", F.slice("w", F.col("p"), F.col("n")).alias("gram"))
            .groupBy("gram").agg(F.sort_array(F.collect_set("item_id")).alias("items")))


def _covered(spans: Column) -> Column:
    """Words inside the union of sorted (begin, end) spans."""
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["at"], s["begin"] - 1))).alias("n")),
        lambda a: a["n"])


def scan(docs: DataFrame, bench: DataFrame, keys: dict[str, Column], width: int = 10,
         max_broadcast: int = 2_000_000) -> DataFrame:
    """One row per value of ``keys``: n_words, spans (begin, end; 1-based words),
    n_hit and items (sorted ids of the items with occurring windows)."""
    grams = checkpointed(windows(bench, width))
    seen = grams.agg(F.count("*").alias("n"), F.collect_set(F.size("gram")).alias("sizes")).first()
    sizes = sorted(seen["sizes"]) or [width]  # at most ``width`` different ones
    held = grams.select(F.xxhash64("gram").alias("gh"), F.col("gram").alias("gram2"), "items")
    if seen["n"] <= max_broadcast:
        held = F.broadcast(held)
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], words_of(F.col("text")).alias("w"))
    # position 0 stands for the document itself, so that each row comes out
    last = F.greatest(F.size("w") - sizes[0] + 1, F.lit(0))
    at = rows.select(*keys, "w", F.size("w").cast("bigint").alias("n_words"),
                     F.explode(F.sequence(F.lit(0), last)).alias("p"))
    if len(sizes) == 1:
        at = at.withColumn("n", F.lit(sizes[0]))
    else:
        at = (at.withColumn("n", F.explode(F.array(*[F.lit(s) for s in sizes])))
              .where(((F.col("p") == 0) & (F.col("n") == sizes[0]))
                     | ((F.col("p") > 0) & (F.col("p") + F.col("n") - 1 <= F.size("w")))))
    at = at.withColumn("gram", F.when(F.col("p") > 0, F.slice("w", F.greatest(F.col("p"), F.lit(1)), F.col("n"))))
    met = at.join(held, F.xxhash64("gram", F.when(F.col("p") == 0, F.col("n_words"))) == F.col("gh"), "left")
    found = met.where((F.col("p") == 0) | (F.col("gram") == F.col("gram2")))  # the verification
    hit = F.struct(F.col("p").alias("begin"), (F.col("p") + F.col("n") - 1).alias("end"))
    per = found.groupBy(*keys, "n_words").agg(
        F.sort_array(F.collect_set(F.when(F.col("p") > 0, hit))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("p") > 0, F.col("items")))))).alias("items"))
    return per.withColumn("n_hit", _covered(F.col("spans")))


def report(docs: DataFrame, bench: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated) of each row."""
    out = scan(docs, bench, {"_row": F.monotonically_increasing_id(), "doc_id": F.col("doc_id")}, width)
    return out.drop("_row").withColumn("contaminated", F.col("n_hit") > 0)


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` less the words of ``spans`` (with what stands before each of them)."""
    parts = F.regexp_extract_all(text, F.lit(f"{_RAW_GAP}*{_RAW_WORD}+"), F.lit(0))
    tail = F.regexp_extract(text, f"{_RAW_GAP}*$", 0)
    kept = F.filter(parts, lambda x, i: ~F.exists(
        spans, lambda s: (i + 1 >= s["begin"]) & (i + 1 <= s["end"])))
    return F.concat(F.array_join(kept, ""), tail)


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = 10, remove: str = "documents",
                  max_broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` without contaminated documents (``remove='documents'``), or with
    the hit spans cut out of their texts (``'spans'``). Columns stay as they are.

    Hits are found per distinct text (by its MD5), written to the shared folder,
    and joined back; they are broadcast only below ``max_broadcast_rows``."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    names = docs.columns
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    k, hit, spans = (fresh_name(names, x) for x in ("_text_key", "_hit_key", "_hit_spans"))
    hits = checkpointed(scan(docs, bench, {hit: key}, width).where("n_hit > 0")
                        .select(hit, F.col("spans").alias(spans)))
    if hits.count() <= max_broadcast_rows:
        hits = F.broadcast(hits)
    rows = docs.withColumn(k, key)
    if remove == "documents":
        out = rows.join(hits, F.col(k) == F.col(hit), "left_anti")
        return out.select(*[F.col(f"`{c}`") for c in names])
    out = rows.join(hits, F.col(k) == F.col(hit), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(without_spans(F.col("text"), F.col(spans)))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names])
