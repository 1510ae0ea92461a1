"""One registered query per operator: thin digests of the operators' outputs."""

from __future__ import annotations

import os
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelab.functions.url import bind
from pagelab.llm import (bpe, decontaminate, licenses, lm, maintext, mix, periodic, quality, resample, simhash,
                         tokencount, urls, warc)
from pagelab.llm.common import SPACE_WORD, shared_path, table, word_array

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_decontamination", """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (
  SELECT item_id, w[p:p + least(len(w), 10) - 1] AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
m AS (
  SELECT r, w, item_id, gram FROM d JOIN g
  ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(gram, ' ') || ' ')),
h AS (
  SELECT DISTINCT r, unnest(range(p, p + l)) AS x FROM (
    SELECT r, len(gram) AS l, unnest(list_filter(range(1, len(w) - len(gram) + 2),
      lambda p: w[p:p + len(gram) - 1] = gram)) AS p FROM m)),
i AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM h GROUP BY r)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 normalised words of every benchmark item against all documents."""
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


def vocabulary_path() -> str:
    """The registered query's vocabulary: pieces and scores of a public tokenizer."""
    return os.environ.get("PAGELAB_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a unigram tokenizer of 32,000 pieces."""
    docs = table(spark, sf_dir, "documents")
    out = tokencount.with_counts(docs, tokencount.load(vocabulary_path()))
    return out.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), "n_tokens")


@query("op3_warc")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record, then read back from the archives."""
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, min_bytes=0)
    found = warc.records(warc.read(spark, path, with_payload=False))
    return found.select(warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", warc.page_number("refers_to").alias("refers_to"))


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence templates that a span of words of each document matches."""
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.8, spans="words",
                        tell_apart=True)
    names = F.transform("licenses", lambda m: m["license"])
    return out.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"),
                      F.array_join(names, ",").alias("license_ids"),
                      F.array_max(F.transform("licenses", lambda m: m["dice"])).alias("best_dice"), "licenses")


@query("op5_lm_score")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney scores of all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    out = lm.score(docs, model)
    return out.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score", "perplexity")


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, fingerprints within 4 bits link."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"), "class_size")


@query("op7_mix_sources")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn and share 150 % of all words, at most two passes each."""
    out = mix.plan(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2)
    return out.select("doc_id", "source", "size", "source_size", "target",
                      (F.col("size") * F.size("copies")).alias("taken"), "copies")


#: (host, path, action) of the registered URL filter.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op8_url_filter", """
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest,
    CASE WHEN instr(url, '://') > 0 THEN split_part(url, '#', 1) END AS node FROM pages),
r(host, path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
s AS (
  SELECT row_number() OVER () AS k, page_id, node, html,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
f AS (
  SELECT s.*, (SELECT max_by(r.host || r.path || ' ' || r.action, length(r.host || r.path)) FROM r
     WHERE ('.' || s.host) LIKE ('%.' || r.host) AND starts_with(s.path, r.path)) AS best FROM s),
e AS (
  SELECT node AS a, regexp_extract(html, '<link[^>]*rel="canonical"[^>]*href="([^"#]*)', 1) AS b FROM f
  WHERE html LIKE '%rel="canonical"%'),
reach(a, b) AS (
  SELECT node, node FROM f WHERE node IS NOT NULL AND node IN (SELECT a FROM e UNION SELECT b FROM e)
  UNION SELECT reach.a, x.b FROM reach JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) x ON x.a = reach.b),
bad AS (SELECT DISTINCT reach.a FROM reach JOIN f ON f.node = reach.b WHERE split_part(best, ' ', 2) = 'block')
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule,
  CASE WHEN best IS NOT NULL THEN split_part(best, ' ', 2)
       WHEN node IN (SELECT a FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM f
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: the longest rule, else what its aliases say."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    out = urls.judge(table(spark, sf_dir, "pages"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


@query("op9_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with tag weights learned from the marked-up ones."""
    pages = table(spark, sf_dir, "pages")
    out = maintext.extract(pages, maintext.learn(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the learned decision list."""
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    out = quality.judge(docs, rules)
    return out.select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in quality.COUNTS[:5]],
                      "base_failed", "kept", "rule")


def planted(doc_id, text):
    """The contract's texts: one document in ten repeats, from a word on, the words before its end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def looped(w):
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        loop = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        times = F.ceil((n - a) / p).cast("int")
        return F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.flatten(F.array_repeat(loop, times))), F.lit(1), n)

    words = bind(word_array(text, SPACE_WORD), lambda w: F.when(F.size(w) > 0, looped(w)).otherwise(w))
    return F.when(h % 10 == 0, F.array_join(words, " ")).otherwise(text)


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of 24 words and three periods in every document, and the text without their repeats."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    out = periodic.with_runs(docs, min_words=24, min_periods=3).withColumn("best", periodic.strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


@query("op12_importance_resampling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn to resemble the benchmark's word pairs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gain = resample.learn(docs, table(spark, sf_dir, "benchmark"), max_words=2, buckets=10_000)
    out = resample.draw(resample.weigh(docs, gain, max_words=2).drop("text"), share=Fraction(25, 100), min_words=20, seed=7)
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def bpe_ranks():
    """The registered query's ranks: a byte-level vocabulary of a public tokenizer."""
    import public_tokenizers
    path = os.environ.get("PAGELAB_BPE_RANKS", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.load(path, public_tokenizers.PATTERN)


@query("op13_bpe_round_trip")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to token ids and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = bpe.Tokenizer(docs, bpe_ranks())
    out = tokenizer.with_bytes(tokenizer.with_ids(docs).drop("text"))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
