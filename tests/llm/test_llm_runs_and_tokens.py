"""Periodic runs, importance resampling, byte-level BPE."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelab.llm import bpe, periodic, queries, resample

DOCS = "doc_id long, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def write(spark, tmp_path, rows, benchmark=()):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# -- periodic runs -----------------------------------------------------------------
def brute_runs(w, least=24, periods=3):
    """Every lag and every maximal stretch of equal words, kept if no smaller period holds in it."""
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            start, length = i, j + q - i
            smallest = next(p for p in range(1, q + 1) if all(w[k] == w[k + p] for k in range(start, start + length - p)))
            if smallest == q and length >= max(least, periods * q):
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(w, runs):
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [x for k, x in enumerate(w) if k not in dropped]


def run_texts():
    rng = random.Random(3)
    out = []
    for _ in range(250):
        w = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.5:
                loop = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
                n = rng.randint(1, 70)
                w += (loop * (n // len(loop) + 1))[:n]
            else:
                w += [rng.choice("abcdefghé") for _ in range(rng.randint(0, 30))]
        out.append(" ".join(w))
    out += ["", " \n ", "a " * 23, "a " * 24, "a b " * 12, "a b c d e f g h " * 3, "a b c d e f g h i " * 3,
            "x " + "a b " * 13 + "a", "a\x0bb\x0cc\n" * 9, "é é " * 30]
    return out


@pytest.mark.parametrize("least, periods", [(24, 3), (6, 3), (12, 4)])
def test_runs_of_many_texts_at_once(least, periods):
    texts = run_texts()
    words, runs = periodic.find_runs([t.encode() for t in texts], least, periods)
    for t, w, r in zip(texts, words, runs):
        assert [x.decode() for x in w] == WORDS.findall(t)
        assert [tuple(x) for x in r.tolist()] == brute_runs(w, least, periods), t
        assert periodic.collapse(w, r) == b" ".join(brute_collapse(w, brute_runs(w, least, periods)))


def test_long_runs_of_long_periods():
    rng = random.Random(4)
    loop = [str(rng.randint(0, 400)) for _ in range(20_000)]
    noise = [str(rng.randint(0, 30)) for _ in range(30_000)]
    text = " ".join([*noise, "x", *loop * 3, *loop[:7], "y", *noise[:50] * 4]).encode()
    _, (runs, none) = periodic.find_runs([text, b"a b c"])
    assert [30_001, 60_007, 20_000] in runs.tolist() and len(none) == 0
    assert any(r[2] == 50 and r[1] >= 200 for r in runs.tolist())


def test_splitting_keeps_every_run_and_drops_the_rest():
    rng = random.Random(5)
    words = [rng.randint(0, 10**6) for _ in range(5_000)]
    words[2000:2060] = list(range(20)) * 3
    place = periodic.split(np.array(words), np.array([len(words)]), 24, 3)
    assert place.tolist() == list(range(2000, 2060))


def test_runs_need_three_periods():
    with pytest.raises(ValueError):
        periodic.find_runs([b"a"], 24, 2)


def test_op11_against_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(run_texts())] + [(7, "a " * 30), (None, "b " * 40), (900, None)]
    rows += [(i, " ".join(str(k * i % 97) for k in range(i % 260))) for i in range(1000, 1200)]
    sf = write(spark, tmp_path, rows)
    got = sorted(map(tuple, queries.QUERIES["op11_periodic_runs"](spark, sf).drop("n_words").collect()), key=str)
    want = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(brute_collapse(w, runs)))))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > 50


def test_runs_beside_clashing_columns_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a " * 30, "x", 5)], "doc_id long, text string, runs string, n_words int")
    r = periodic.with_runs(docs).first()
    assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"], r["text"]) == (30, [(0, 30, 1)], "a", "a " * 30)
    assert periodic.with_runs(docs.limit(0)).count() == 0


# -- importance resampling -------------------------------------------------------------
def brute_features(text, n=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def crc(x):
    return zlib.crc32(x.encode()) % 10_000


def brute_resample(rows, target):
    total, aim = Counter(), Counter()
    for _, t in rows:
        total.update(map(crc, brute_features(t)[1]))
    for _, t in target:
        aim.update(map(crc, brute_features(t)[1]))
    s_all, t_all = sum(total.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((total[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for i, t in rows:
        w, f = brute_features(t)
        weight = sum(gain[crc(x)] for x in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:25 * len(fit) // 100], 1):
        r[4] = k
    return out


def resample_rows():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcÉé3語") for _ in range(rng.randint(1, 5))) for _ in range(300)] + ["w" * 200, "Ü" * 90]
    seps = [" ", "\n", "-", "\0", ". ", "_"]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice(seps) for _ in range(rng.randint(0, 60)))) for i in range(240)]
    return rows + [(240, None), (241, ""), (242, "\0"), (243, "- -"), (244, "x " * 3_000), (None, "null id " * 30)]


def test_op12_against_brute_force(spark, tmp_path):
    rows = resample_rows()
    target = [("q1", rows[3][1]), ("q2", (rows[5][1] or "").upper()), ("q3", None), ("q4", "x x x")]
    got = queries.QUERIES["op12_importance_resampling"](spark, write(spark, tmp_path, rows, target))
    assert got.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {k: v for k, v in got.dtypes} == {c: "bigint" for c in got.columns}
    assert sorted(map(list, got.collect()), key=str) == sorted(brute_resample(rows, target), key=str)


def test_resampling_with_repeated_rows_and_empty_tables(spark, tmp_path):
    rows = [(5, "same words again " * 10)] * 40 + [(6, "other words here " * 10)] * 20
    sf = write(spark, tmp_path, rows)
    ranks = sorted(r["rank"] for r in queries.QUERIES["op12_importance_resampling"](spark, sf).collect() if r["rank"])
    assert ranks == list(range(1, 16))
    docs = spark.createDataFrame(rows, DOCS)
    assert resample.draw(resample.weigh(docs.limit(0), [0] * 10)).count() == 0
    clash = docs.withColumns({"weight": F.lit("x"), "rank": F.lit("y"), "score": F.lit("z")})
    out = resample.draw(resample.weigh(clash, [1] * 10), share=Fraction(1, 2))
    assert out.where("rank is not null").count() == 30 and out.where("weight = 1").count() == 60


def test_longer_ngrams_and_joined_checksums():
    texts = [(t or "").encode() for _, t in resample_rows()]
    for n in (1, 2, 3, 4):
        bucket, at, words = resample.features(texts, n, 1 << 20)
        for k, t in enumerate(texts):
            w, f = brute_features(t.decode(), n)
            assert Counter(bucket[at == k].tolist()) == Counter(zlib.crc32(x.encode()) % (1 << 20) for x in f)
            assert words[k] == len(w)
    a, b = b"some bytes", b"more" * 100
    got = resample._joined_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
    assert got.tolist() == [zlib.crc32(a + b)]


def test_counts_do_not_depend_on_batches(spark):
    rows = resample_rows()
    docs = spark.createDataFrame(rows, DOCS)
    one, many = ({r["bucket"]: r["n"] for r in resample.bucket_counts(docs.repartition(n)).collect()} for n in (1, 7))
    assert one == many and sum(one.values()) == sum(len(brute_features(t)[1]) for _, t in rows)


# -- byte-level BPE -------------------------------------------------------------------
def library(ranks):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=ranks.pattern, mergeable_ranks={t: i for i, t in ranks.tokens.items()}, special_tokens={})


def bpe_texts():
    rng = random.Random(9)
    out = ["".join(rng.choice("abcdeté 語🤖\n  'sll  12,. \t") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return out + ["", " ", "\n\n  x", "a" * 5_000, "語" * 700, "the " * 300, "x" * 256, "x" * 257, "ab" * 129, "é" * 200 + " b",
                  "<|endoftext|>", "it's they'LL we've", "\x00\x1c\x85", "é" * 50]


def test_op13_against_the_library(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(bpe_texts())] + [(3, "twice"), (3, "twice"), (None, "no id"), (9_000, None)]
    ranks = queries.bpe_ranks()
    theirs = library(ranks)
    got = sorted(map(tuple, queries.QUERIES["op13_bpe_round_trip"](spark, write(spark, tmp_path, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha((t or "").encode())))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("matrix", [0, 6, 256])
def test_merges_of_odd_vocabularies(monkeypatch, matrix):
    """Tokens that no merge reaches, ranks that fall as tokens grow, ties: rows of the matrix
    and the heap follow the rule as the library does."""
    monkeypatch.setattr(bpe, "MATRIX_BYTES", matrix)
    rng = random.Random(10)
    for _ in range(25):
        tokens = [bytes([b]) for b in range(256)]
        more = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(40)}
        tokens += rng.sample(sorted(more), len(more))
        ranks = bpe.Ranks(dict(enumerate(tokens)), r"\w+|\W+")
        mine, theirs = bpe.Encoder(ranks, hold=30), library(ranks)
        for _ in range(3):
            texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 40))) for _ in range(20)]
            ids, per = mine.encode(texts)
            parts = np.split(ids, np.cumsum(per)[:-1])
            assert [p.tolist() for p in parts] == [theirs.encode_ordinary(t) for t in texts]
            assert bpe.decode(ranks.tokens, ids, per) == [t.encode() for t in texts]


def test_ranks_that_cannot_be_used(tmp_path):
    p = tmp_path / "r.tiktoken"
    p.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(256)))
    ranks = bpe.load(str(p), r"\S+|\s+")
    e = bpe.Encoder(ranks)
    assert [x.tolist() for x in e.encode(["ab"])] == [[97, 98], [2]]
    with pytest.raises(ValueError):
        bpe.decode(ranks.tokens, np.array([256]), np.array([1]))
    with pytest.raises(ValueError):
        bpe.load(str(p), "x", max_tokens=255)
    with pytest.raises(ValueError):
        bpe.Encoder(bpe.Ranks({0: b"a"}, "x"))


def test_ids_beside_clashing_columns_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "ab ab", 4), (2, None, 5)], "doc_id long, text string, ids int")
    t = bpe.Tokenizer(docs, queries.bpe_ranks())
    out = t.with_bytes(t.with_ids(docs))
    assert {r["doc_id"]: (bytes(r["decoded"]), r["text"]) for r in out.collect()} == {1: (b"ab ab", "ab ab"), 2: (b"", None)}
    assert t.with_bytes(docs.select(F.lit(None).cast("array<int>").alias("ids"))).where("decoded is null").count() == 2
    assert t.with_bytes(t.with_ids(docs.limit(0))).count() == 0
