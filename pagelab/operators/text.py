"""E: n-grams, TF-IDF fit/transform, vocabularies and padded id sequences.

Terms of a page are counted inside its row; term statistics are one shuffle by
term of counts already summed per task. A fitted vocabulary is bounded
by ``max_features`` (or ``vocab_size``), which is what makes broadcasting it
safe.

TF-IDF follows the smooth-idf form ``ln((1 + N) / (1 + df)) + 1`` (N counts
empty documents), raw term counts, L2 normalisation per document; the
vocabulary is the ``max_features`` terms with the largest corpus count (ties
by term), indexed in alphabetical order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelab.operators.stats import top_k_per_group

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# words dropped from URL keyword tables
URL_KEYWORD_STOP = ["http", "https", "www", "com", "net", "org", "html", "php"]
# words dropped from the word-frequency tables (custom part of the stop list)
WORD_FREQ_STOP = ["http", "https", "www", "com", "org", "net", "html", "php", "login", "index", "htm"]
# general English words left out of word clouds, those of three letters or more without an apostrophe
ENGLISH_STOP = """about above after again against all also and any are because been before being below between both but
can cannot com could did does doing down during each else ever few for from further get had has have having hence her
here hers herself him himself his how however http into its itself just like more most myself nor not off once only
other otherwise ought our ours ourselves out over own same shall she since should some such than that the their theirs
them themselves then there therefore these they this those through too under until very was were what when where which
while who whom why with would www you your yours yourself yourselves""".split()
# characters spaced out before sub-word splitting of URLs
SUBWORD_SPLIT_CHARS = r"([./\-_?=&])"
# ASCII punctuation removed by the sub-word standardisation
ASCII_PUNCT_RE = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
_ID_ROWS = 256  # rows whose terms are looked up at once
HYBRID_TOKEN_RE = r"[\p{L}\p{N}_']+|[^\p{L}\p{N}_\s]"
# ---------------------------------------------------------------------------


def word_ngrams(tokens, lo: int, hi: int) -> Column:
    """All n-grams (lo <= n <= hi) of a token array, n-major order."""
    from pagelab.functions.url import bind

    def grams_of(t):
        def grams(n):
            k = F.size(t) - n + 1
            return F.when(k >= 1, F.transform(F.sequence(F.lit(1), k),
                                              lambda i: F.array_join(F.slice(t, i, n), " "))
                          ).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.array(*[grams(n) for n in range(lo, hi + 1)]))
    return bind(F.col(tokens) if isinstance(tokens, str) else tokens, grams_of)


def char_wb_ngrams(text, lo: int = 1, hi: int = 4) -> Column:
    """Character n-grams inside space-padded words (word-boundary analyser)."""
    words = F.filter(F.split(F.lower(F.col(text) if isinstance(text, str) else text), r"\s+"), lambda w: w != "")

    def per_word(w):
        p = F.concat(F.lit(" "), w, F.lit(" "))
        L = F.length(p)
        return F.flatten(F.transform(F.sequence(F.lit(lo), F.least(F.lit(hi), L)),
                                     lambda n: F.transform(F.sequence(F.lit(1), L - n + 1),
                                                           lambda i: F.substring(p, i, n))))
    return F.flatten(F.transform(words, per_word))


def counted(terms) -> Column:
    """array<struct<term, tf>> of a term array, by ascending term: the array is
    sorted and cut where the term changes, inside the row."""
    from pagelab.functions.url import bind
    t = F.col(terms) if isinstance(terms, str) else terms

    def runs(g):
        starts = F.filter(F.sequence(F.lit(1), F.size(g)),
                          lambda i: (i == 1) | (F.element_at(g, i) != F.element_at(g, F.greatest(i - 1, F.lit(1)))))
        return bind(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.element_at(g, i).alias("term"),
            (F.coalesce(F.get(at, k + 1), F.size(g) + 1) - i).cast("long").alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return bind(F.array_sort(F.coalesce(t, F.array().cast("array<string>"))),
                lambda g: F.when(F.size(g) > 0, runs(g)).otherwise(none))


def term_counts(docs: DataFrame, key: str, terms: str, groups=()) -> DataFrame:
    """(groups, key, term, tf) for the non-empty documents (one row per document):
    counts are taken inside the row, nothing is shuffled."""
    x = docs.select(*groups, key, F.explode(counted(terms)).alias("c"))
    return x.select(*groups, key, "c.term", "c.tf")


def tfidf_fit(docs: DataFrame, key: str, terms: str, max_features: int, groups=(),
              limits: dict | None = None) -> DataFrame:
    """Vocabulary (groups, term, idx, df, total, idf), one per group;
    ``limits`` maps a value of the single group column to its own size."""
    groups = list(groups)
    # one shuffle, by term, of counts summed per task
    stats = term_counts(docs, key, terms, groups).groupBy(*groups, "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    n_docs = docs.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    top = top_k_per_group(stats, groups, [F.desc("total"), F.col("term")], max_features, "term", out="_r")
    if limits:
        lim = None
        for gv, k in limits.items():
            lim = F.when(F.col(groups[0]) == gv, F.lit(k)) if lim is None else lim.when(F.col(groups[0]) == gv, F.lit(k))
        top = top.where(F.col("_r") <= lim.otherwise(F.lit(max_features)))
    top = top.drop("_r")
    wa = Window.partitionBy(*groups).orderBy("term")  # at most max_features rows per group
    top = top.withColumn("idx", F.row_number().over(wa) - 1)
    top = top.join(F.broadcast(n_docs), groups, "inner") if groups else top.join(F.broadcast(n_docs), how="inner")
    return top.select(*groups, "term", "idx", "df", "total",
                      (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_transform(docs: DataFrame, key: str, terms: str, vocab: DataFrame, groups=()) -> DataFrame:
    """Long TF-IDF (groups, key, term, idx, weight), L2-normalised per
    document; terms outside the vocabulary are ignored. The vocabulary (bounded
    by max_features) is a broadcast dictionary. Terms reach it one row each, in the
    order of their documents, so a batch is bounded by its rows whatever the pages' size, and only
    the hits of one document are held: no shuffle."""
    groups = list(groups)
    table: dict[tuple, dict] = {}
    for r in vocab.select(*groups, "term", "idx", "idf").collect():  # at most max_features rows per group
        table.setdefault(tuple(r[g] for g in groups), {})[r["term"]] = (int(r["idx"]), float(r["idf"]))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    src = docs.select(*groups, key, F.posexplode(counted(terms)).alias("_at", "_c"))
    heads = src.schema.fields[:-2]
    src = src.select(*[f.name for f in heads], "_at", "_c.term", "_c.tf")  # a document starts at 0
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in heads), "term string", "idx int", "weight double"])
    n = len(heads)

    def weigh(batches):
        head, held = None, []
        for b in batches:
            rows, kinds = [], [b.schema.field(i).type for i in range(n)]
            for *of, at, term, tf in zip(*(c.to_pylist() for c in b.columns)):
                if at == 0:
                    rows += done(head, held)
                    head, held, known = of, [], shared.value.get(tuple(of[:-1]), {})
                elif not held:
                    known = shared.value.get(tuple(of[:-1]), {})
                if term in known:
                    held.append((term, *known[term], tf))
            yield made(rows, kinds)
        if held:
            yield made(done(head, held), kinds)

    def done(head, held):
        norm = math.sqrt(sum((tf * idf) ** 2 for _, _, idf, tf in held))
        return [(*head, term, idx, tf * idf / norm) for term, idx, idf, tf in held]

    def made(rows, kinds):
        kinds = [*kinds, pa.string(), pa.int32(), pa.float64()]
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                          names=[*(f.name for f in heads), "term", "idx", "weight"])

    return src.mapInArrow(weigh, out)


def tfidf_fit_transform(docs: DataFrame, key: str, terms: str, max_features: int, groups=()):
    """E2 + E3 on the same documents. Returns (vocabulary, weights)."""
    vocab = tfidf_fit(docs, key, terms, max_features, groups)
    return vocab, tfidf_transform(docs, key, terms, vocab, groups)


def tfidf_scaled_norms(long: DataFrame, docs: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, dim, sq_norm): width and squared length of each document's z-scored
    (population sigma) TF-IDF vector, without the dense vector: a document's own
    terms add their difference to the sum that an empty document has."""
    n = docs.count()
    st = long.groupBy("idx").agg((F.sum("weight") / n).alias("mu"), (F.sum(F.col("weight") * F.col("weight")) / n).alias("sq"))
    var = F.col("sq") - F.col("mu") * F.col("mu")
    st = st.select("idx", "mu", F.when(var > 1e-18, F.sqrt(var)).otherwise(F.lit(1.0)).alias("sd"))
    empty = st.agg(F.sum(F.pow(F.col("mu") / F.col("sd"), 2)).alias("z0")).first()["z0"] or 0.0  # one number
    x = long.join(F.broadcast(st), "idx")  # at most max_features rows
    gain = F.pow((F.col("weight") - F.col("mu")) / F.col("sd"), 2) - F.pow(F.col("mu") / F.col("sd"), 2)
    own = x.groupBy(key).agg(F.sum(gain).alias("_g"))
    return docs.select(key).join(own, key, "left").select(
        key, F.lit(vocab.count()).alias("dim"), (F.lit(float(empty)) + F.coalesce("_g", F.lit(0.0))).alias("sq_norm"))


def tag_tokens(html: str = "html") -> Column:
    from pagelab.functions.dom import tag_sequence
    return tag_sequence(html)


def hybrid_tokens(html) -> Column:
    """Lower-case words (letters, digits, _ and ') or single other symbols."""
    h = F.lower(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")))
    return F.regexp_extract_all(h, F.lit(HYBRID_TOKEN_RE), 0)


def frequency_vocab(docs: DataFrame, terms: str, size: int, first_id: int = 2, groups=()) -> DataFrame:
    """The (size - first_id) most frequent terms, ids from first_id
    (count desc, ties by term)."""
    x = docs.select(*groups, F.explode(terms).alias("term")).groupBy(*groups, "term").agg(F.count(F.lit(1)).alias("cnt"))
    x = top_k_per_group(x, groups, [F.desc("cnt"), F.col("term")], size - first_id, "term", out="_r")
    return x.select(*groups, "term", (F.col("_r") + first_id - 1).alias("id"), "cnt")


def ids_from_vocab(docs: DataFrame, key: str, terms: str, vocab: DataFrame, length: int,
                   unknown: int = 1, out: str = "ids") -> DataFrame:
    """First ``length`` terms -> ids (unknown id for others), zero padded.

    The vocabulary (bounded by its size parameter) is a broadcast dictionary that
    Arrow batches of documents look their terms up in, a bounded number of
    rows at a time: no join, no shuffle."""
    table = {r["term"]: int(r["id"]) for r in vocab.select("term", "id").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    src = docs.select(key, F.slice(F.coalesce(F.col(terms), F.array().cast("array<string>")), 1, length).alias(out))

    def ids(batches):
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _ID_ROWS):  # terms are Python strings for so many rows at a time
                part = batch.slice(at, _ID_ROWS)
                rows = part.column(1)
                found = np.array([known.get(t, unknown) for t in rows.flatten().to_pylist()], np.int32)
                wide = np.zeros((len(rows), length), np.int32)
                wide[np.arange(length) < np.diff(rows.offsets.to_numpy())[:, None]] = found
                made = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * length, wide.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=[key, out])

    return src.mapInArrow(ids, f"`{key}` {src.schema.fields[0].dataType.simpleString()}, `{out}` array<int>")


def url_char_ids(url, length: int = 180) -> Column:
    """Code point + 2 for ASCII characters, 1 otherwise; zero padded."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    chars = F.filter(F.split(F.substring(u, 1, length), ""), lambda c: c != "")
    ids = F.transform(chars, lambda c: F.when(F.ascii(c) < 128, F.ascii(c) + 2).otherwise(F.lit(1)))
    return F.concat(ids, F.array_repeat(F.lit(0), F.lit(length) - F.size(ids)))


def char_frequency_vocab(df: DataFrame, url: str = "url", num_words: int = 128) -> DataFrame:
    """E12 fit: characters of the lower-cased URLs by frequency, ids from 2
    (1 is the unknown id); only ids below ``num_words`` are kept, so the
    result has at most num_words - 2 rows."""
    chars = F.filter(F.split(F.lower(F.col(url)), ""), lambda c: c != "")
    return frequency_vocab(df.select(chars.alias("_c")), "_c", num_words, 2)


def char_frequency_ids(df: DataFrame, vocab: DataFrame, key: str = "page_id", url: str = "url",
                       length: int = 256) -> DataFrame:
    """E12 transform: each character -> its id (1 when unknown or rare),
    post-truncated and post-padded to ``length``. The vocabulary holds at most
    num_words - 2 characters, so it is applied as an in-row map."""
    pairs = vocab.select("term", "id").collect()  # bounded: < num_words rows
    m = F.create_map(*[x for r in pairs for x in (F.lit(r["term"]), F.lit(int(r["id"])))]) if pairs else None
    chars = F.filter(F.split(F.lower(F.col(url)), ""), lambda c: c != "")
    ids = F.transform(chars, lambda c: F.coalesce(m[c], F.lit(1)) if m is not None else F.lit(1))
    ids = F.slice(ids, 1, length)
    return df.select(key, F.concat(ids, F.array_repeat(F.lit(0), F.lit(length) - F.size(ids))).alias("ids"))


def url_subword_tokens(url) -> Column:
    """E13 tokens: punctuation spaced out, lower-cased, ASCII punctuation
    stripped, whitespace split."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    t = F.lower(F.regexp_replace(u, SUBWORD_SPLIT_CHARS, " $1 "))
    t = F.regexp_replace(t, ASCII_PUNCT_RE, "")
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def url_keyword_tokens(url) -> Column:
    """E14 tokens: host + path of the URL split on non-letters, words longer
    than 3 letters outside the stop list."""
    from pagelab.functions.url import netloc, path
    u = F.col(url) if isinstance(url, str) else url
    u2 = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("http://"), u))
    text = F.lower(F.concat(netloc(u2), path(u2)))
    return F.filter(F.split(text, "[^a-zA-Z]"),
                    lambda w: (F.length(w) > 3) & ~w.isin(URL_KEYWORD_STOP))


def top_terms(docs: DataFrame, terms: str, k: int, groups=()) -> DataFrame:
    """Top-k terms by count per group (ties by term)."""
    x = docs.select(*groups, F.explode(terms).alias("term")).groupBy(*groups, "term").agg(F.count(F.lit(1)).alias("count"))
    return top_k_per_group(x, groups, [F.desc("count"), F.col("term")], k, "term", out="rank")


def page_words(html) -> Column:
    """Words of 3+ ASCII letters in the visible text (script, style and
    comments dropped; entities treated as separators), lower-cased."""
    h = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    t = F.regexp_replace(h, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]+>|&[a-zA-Z]+;|&#[0-9]+;", " ")
    return F.transform(F.regexp_extract_all(t, F.lit("[a-zA-Z]{3,}"), 0), lambda w: F.lower(w))


def url_words(url) -> Column:
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.transform(F.regexp_extract_all(u, F.lit("[a-zA-Z]{3,}"), 0), lambda w: F.lower(w))


def word_frequencies(docs: DataFrame, words: str, groups, k: int = 150, stop=tuple(WORD_FREQ_STOP)) -> DataFrame:
    """Top-k words per group minus ``stop`` words, weight = count / top count."""
    x = docs.select(*groups, F.filter(words, lambda w: ~w.isin(list(stop))).alias("_w"))
    t = top_terms(x, "_w", k, groups)
    mx = t.groupBy(*groups).agg(F.max("count").alias("_mx"))
    return t.join(F.broadcast(mx), list(groups)).select(*groups, F.col("term").alias("word"), "count", "rank",
                                                        (F.col("count") / F.col("_mx")).alias("weight"))
