"""Token counts, WARC, licences, language model, URL filter, main text, quality rules."""

import base64
import gzip
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from pagelab.llm import licenses, lm, maintext, quality, queries, tokencount, urls, warc
from pagelab.llm.common import shared_path

DOCS = "doc_id long, text string"
PAGES = "page_id long, url string, html string"


# -- token counts --------------------------------------------------------------
def library(vocabulary, cut=True):
    rows = [("<unk>", 0.0), *vocabulary.pieces]
    if vocabulary.byte_fallback:
        rows += [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    t = Tokenizer(models.Unigram(rows, 0, byte_fallback=vocabulary.byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=cut)
    return t


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_follow_the_library_on_ties(fallback):
    rng = random.Random(5)
    for _ in range(60):
        pieces = {"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 4))): float(-rng.randint(0, 4)) for _ in range(12)}
        v = tokencount.Vocabulary(tuple(pieces.items()), fallback)
        mine, theirs = tokencount.Counter(v, hold=8), library(v)
        for _ in range(25):
            x = "".join(rng.choice("abcdé 語") for _ in range(rng.randint(0, 14)))
            assert mine.text(x) == len(theirs.encode(x).ids), (pieces, x)


def test_token_counts_with_the_registered_vocabulary(spark, sf001):
    v = tokencount.load(queries.vocabulary_path())
    texts = [r["text"] for r in spark.read.parquet(f"{sf001}/documents.parquet").select("text").limit(60).collect()]
    texts += [None, "", " ", "  a  b ", "x\ny\tz", "▁a", "日本 🤖🤖", "é" * 3000, "word " * 5000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, known int")
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.with_counts(docs, v).collect()}
    theirs = library(v)
    assert got == {i: len(theirs.encode(t).ids) if t else 0 for i, t in enumerate(texts)}
    assert tokencount.with_counts(docs.limit(0), v).count() == 0


def test_token_counts_without_the_cut_at_marks(spark, sf001):
    rng = random.Random(6)
    for n in range(60):
        pieces = {"".join(rng.choice("ab▁▁c") for _ in range(rng.randint(1, 4))): float(-rng.randint(0, 4)) for _ in range(12)}
        v = tokencount.Vocabulary(tuple(pieces.items()), bool(n % 2))
        mine, theirs = tokencount.Counter(v, cut=False), library(v, cut=False)
        for _ in range(25):
            x = "".join(rng.choice("abcdé  語") for _ in range(rng.randint(0, 14)))
            assert mine.text(x) == len(theirs.encode(x).ids), (pieces, x)
    v = tokencount.load(queries.vocabulary_path())
    texts = [r["text"] for r in spark.read.parquet(f"{sf001}/documents.parquet").select("text").limit(20).collect()]
    texts += [None, "", " ", "x        y", "    indented", "a\n  b   c ", "▁▁a", " " * 3000 + "z" + " " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, cut = ({r["doc_id"]: r["n_tokens"] for r in tokencount.with_counts(docs, v, cut=c).collect()} for c in (False, True))
    theirs = library(v, cut=False)
    assert got == {i: len(theirs.encode(t).ids) if t else 0 for i, t in enumerate(texts)}
    at = texts.index("x        y")
    assert got[at] < cut[at]  # runs of spaces are pieces only where texts are not cut


def test_vocabulary_files(tmp_path):
    p = tmp_path / "v.json"
    p.write_text(json.dumps({"model": {"type": "Unigram", "unk_id": 0, "byte_fallback": True,
                                       "vocab": [["<unk>", 0], ["<0x41>", 0], ["▁a", -1.5]]}}))
    v = tokencount.load(str(p))
    assert v.pieces == (("▁a", -1.5),) and v.byte_fallback
    with pytest.raises(ValueError):
        tokencount.load(str(p), max_pieces=0)
    p.write_text(json.dumps({"model": {"type": "BPE", "vocab": []}}))
    with pytest.raises(ValueError):
        tokencount.load(str(p))
    assert tokencount.Counter(tokencount.Vocabulary((), False)).text("ab c") == 2


# -- WARC --------------------------------------------------------------------------
def page_rows():
    return [(1, "http://a.org/x", "<p>a"), (2, "https://C.org/y z\r\nX: 1", "<p>a"), (3, None, None), (4, "u", ""),
            (None, "u", "<p>é"), (5, "u", "<p>é"), (6, "x", "W" * 17_000_000 + "q"), (7, "x", "\r\n\r\nWARC/1.1\r\n"),
            (9, "x", "twice"), (9, "x", "twice"), (8, "x", "twice")]


def test_warc_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).withColumns({"payload": F.lit(1), "_top": F.lit(2)})
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    for limit in (0, 1000):
        path = shared_path(spark, "test-warc")
        warc.write(pages, path, records_per_file=3, max_broadcast=limit)
        found = warc.read(spark, path)
        assert warc.gaps(found).count() == 0
        got = Counter((r["page_id"], r["record_type"], r["to"], r["payload_bytes"], r["payload_digest"])
                      for r in warc.records(found).withColumns({
                          "page_id": warc.page_number("record_id"), "to": warc.page_number("refers_to")}).collect())
        want = Counter()
        for i, _, h in rows:
            raw = (h or "").encode()
            first = i == top[h or ""]
            want[i, "response" if first else "revisit", None if first else top[h or ""], len(raw),
                 base64.b32encode(hashlib.sha1(raw).digest()).decode()] += 1
        assert got == want
        back = {r["payload_digest"]: r["payload"] for r in warc.records(found).where("record_type = 'response'").collect()}
        assert all(warc.sha1_base32(bytes(p)) == d for d, p in back.items())
        files = spark.read.format("binaryFile").load(path).select("content").collect()
        assert sum(gzip.decompress(bytes(f["content"])).count(b"WARC-Record-ID") for f in files) == len(rows)
    path = shared_path(spark, "test-warc")
    warc.write(pages, path, min_bytes=5)  # shorter payloads never revisit
    kinds = Counter((r["payload_bytes"], r["record_type"]) for r in warc.records(warc.read(spark, path)).collect())
    assert kinds[4, "response"] == 2 and kinds[0, "response"] == 2 and kinds[5, "revisit"] == 2 and kinds[5, "response"] == 3


def test_warc_of_an_empty_table(spark):
    path = shared_path(spark, "test-warc")
    warc.write(spark.createDataFrame([], PAGES), path)
    assert warc.read(spark, path).count() == 0


def test_warc_of_very_long_urls(spark):
    rows = [(1, "http://a.org/" + "x" * 1_000_000, "<p>a"), (2, "http://a.org/" + "\u20ac" * 8_000, "<p>b"), (3, "http://a.org/", "<p>c")]
    path = shared_path(spark, "test-warc")
    warc.write(spark.createDataFrame(rows, PAGES), path)
    found = warc.read(spark, path)
    assert warc.gaps(found).count() == 0
    got = {r["page_id"]: r["target_uri"] for r in
           warc.records(found).withColumn("page_id", warc.page_number("record_id")).collect()}
    assert got == {1: rows[0][1], 2: "http://a.org/" + "%E2%82%AC" * 8_000, 3: rows[2][1]}
    # headers that are cut end at the next record of a plain archive
    whole = warc.record(4, "http://a.org/" + "x" * 100_000, b"d", None, False)
    got = list(warc.salvage(whole[:70_000] + b"\r\n" + whole))
    assert [x[:3] for x in got] == [("gap", 0, 70_002), ("record", 70_002, 70_002 + len(whole))]


def test_archives_are_closed_by_bytes(spark):
    rng = random.Random(12)
    size = [300_000, 1_000, 5_000_000, 250_000, 1_100_000, 40_000, 900_000] * 3
    rows = [(i, f"http://x/{i}", base64.b64encode(rng.randbytes(3 * n // 4)).decode()) for i, n in enumerate(size)] + [(90, None, None)]
    path, most = shared_path(spark, "test-warc"), 2_000_000
    warc.write(spark.createDataFrame(rows, PAGES).repartition(2), path, max_file_bytes=most)
    files = spark.read.format("binaryFile").load(path).select("length", "content").collect()
    held = [gzip.decompress(bytes(f["content"])).count(b"WARC-Record-ID") for f in files if f["length"]]
    assert sum(held) == len(rows) and len(held) > 12
    assert all(f["length"] <= most or n == 1 for f, n in zip([f for f in files if f["length"]], held))
    found = warc.read(spark, path, with_payload=False)
    assert warc.gaps(found).count() == 0 and warc.records(found).count() == len(rows)


def test_salvage_recovers_what_is_whole():
    recs = [warc.record(i, f"http://x/{i}", (f"<p>{i}" * (i + 1)).encode(), None, False) for i in range(8)]
    members = [warc.member(r) for r in recs]
    assert [x[0] for x in warc.salvage(b"")] == []
    assert list(warc.salvage(b"garbage"))[0][:3] == ("gap", 0, 7)
    for parts, packed in ((recs, False), (members, True)):
        starts = np.cumsum([0] + [len(p) for p in parts]).tolist()
        data = b"".join(parts)
        rng = random.Random(1)
        for trial in range(60):
            k = rng.randrange(8)
            at = rng.randrange(starts[k] + (0 if not packed else 10), starts[k + 1] - (4 if not packed else 8))
            if trial % 3 == 0:  # bytes lost
                bad = data[:at] + data[at + 3:]
            elif trial % 3 == 1:  # a byte changed
                bad = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1:]
            else:  # the tail lost
                bad = data[:at]
            got = list(warc.salvage(bad))
            ids = [h["warc-record-id"] for kind, _, _, h, _ in got if kind == "record"]
            whole = [f"<urn:x-page:{i}>" for i in range(8) if i != k and (trial % 3 != 2 or i < k)]
            assert [i for i in ids if i in whole] == whole
            covered = sorted({(a, b) for _, a, b, _, _ in got})
            assert covered[0][0] == 0 and covered[-1][1] == len(bad)
            assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
            # a changed header line that no digest covers still passes as a record
            if (at > starts[k]) if trial % 3 == 2 else len(ids) < 8:
                assert any(kind == "gap" for kind, *_ in got)


def test_salvage_inside_a_member():
    rng = random.Random(2)
    recs = [warc.record(i, f"http://x/{i}", rng.randbytes(3_000 * (i + 1)), None, False) for i in range(8)]
    names = lambda found: [h["warc-record-id"] for kind, _, _, h, _ in found if kind == "record"]
    urn = lambda *ids: [f"<urn:x-page:{i}>" for i in ids]
    flat = b"".join(recs)
    bad = bytearray(flat)
    bad[len(b"".join(recs[:3])) + 1_000] ^= 1  # the block of record 3
    for level in (0, 6):  # uncompressed records in a member are told once
        # a whole member with a broken record
        for data in (warc.member(bytes(bad), level), warc.member(b"junk" + flat.replace(recs[3], b""), level)):
            got = list(warc.salvage(data + warc.member(recs[0])))
            assert names(got) == urn(0, 1, 2, 4, 5, 6, 7, 0)
            gaps = [x for x in got if x[0] == "gap"]
            assert len(gaps) == 1 and gaps[0][1] == 0 and "of the content" in gaps[0][3]
        # one member that is cut, or whose content or check sum is damaged
        whole = warc.member(flat, level)
        cut = whole[:len(whole) * 3 // 4]
        got = list(warc.salvage(cut))
        assert names(got) == urn(0, 1, 2, 3, 4, 5) and got[-1][:3] == ("gap", 0, len(cut)) and "cut" in got[-1][3]
        wrong = gzip.compress(flat, level)
        wrong = wrong[:-8] + bytes([wrong[-8] ^ 1]) + wrong[-7:]
        got = list(warc.salvage(wrong + warc.member(recs[0])))
        assert names(got) == urn(*range(8), 0) and [x[:3] for x in got if x[0] == "gap"] == [("gap", 0, len(wrong))]
        # damage in the middle: all that came before it
        hit = bytearray(whole)
        for k in range(20):
            hit[len(whole) // 2 + k] ^= 0x55
        got = list(warc.salvage(bytes(hit) + warc.member(recs[7])))
        assert names(got)[:5] == urn(0, 1, 2, 3, 4) and names(got)[-1:] == urn(7) and any(x[0] == "gap" for x in got)
        assert len(set(names(got)[:-1])) == len(names(got)) - 1
    # the headers of a single record in a damaged member are in doubt
    one = gzip.compress(recs[1])
    assert [x[0] for x in warc.salvage(one[:-8] + bytes(8))] == ["gap"]


# -- licences ------------------------------------------------------------------------
def brute_dice(a, b):
    x, y = licenses.words(a), licenses.words(b)
    p, q = Counter(zip(x, x[1:])), Counter(zip(y, y[1:]))
    n = sum(p.values()) + sum(q.values())
    return 2 * sum((p & q).values()) / n if n else 0.0


def brute_spans(text, threshold=0.8):
    lines = (text or "").split("\n")
    best = {}
    for name, templates in licenses.TEMPLATES.items():
        for t in templates:
            for i in range(len(lines)):
                for j in range(i, len(lines)):
                    if licenses.words(lines[i]) and licenses.words(lines[j]):
                        d = brute_dice("\n".join(lines[i:j + 1]), t)
                        if d >= threshold and d > best.get(name, (0,))[0] + 1e-12:
                            best[name] = (d, i + 1, j + 1)
    out = []
    for name, (d, a, b) in sorted(best.items(), key=lambda x: (-x[1][0], x[0])):
        if all(b < y or z < a for _, _, y, z in out):
            out.append((name, d, a, b))
    return sorted(out)


def test_licences_against_brute_force(spark):
    rng = random.Random(8)
    every = [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts = [None, "", "word", "of the\nthe work"]
    for k in range(40):
        w = rng.choice(every).split()
        for _ in range(rng.randint(0, 1 + len(w) // 8)):
            w[rng.randrange(len(w))] = "changed"
        step = rng.choice([5, 9, 1000])
        body = [" ".join(w[i:i + step]) for i in range(0, len(w), step)]
        noise = lambda: [" ".join(rng.choice("the of and software license word x".split()) for _ in range(rng.randint(0, 9))) for _ in range(3)]
        texts.append("\n".join(noise() + body + noise()))
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: [tuple(x) for x in r["licenses"]] for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert [x[0] for x in got[i]] == [x[0] for x in want]
        assert [x[1] for x in got[i]] == pytest.approx([x[1] for x in want])
    assert sum(map(len, got.values())) > 15
    assert licenses.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.Scanner({"x": ["one"]})


def brute_words(text, threshold=0.8):
    """(licence, first word, word after the last) of all spans of words, best first."""
    w = licenses.words(text)
    every = []
    for name, templates in licenses.TEMPLATES.items():
        for v in map(licenses.words, templates):
            q = Counter(zip(v, v[1:]))
            for a in range(len(w)):
                for b in range(a + 2, min(len(w), a + 2 * len(v)) + 1):
                    p = Counter(zip(w[a:b], w[a + 1:b]))
                    d = 2 * sum((p & q).values()) / (b - a + len(v) - 2)
                    if d >= threshold:
                        every.append((-d, name, a, b))
    taken = []
    for d, name, a, b in sorted(every, key=lambda x: (*x[:3], x[3] - x[2])):
        if all(b <= y or z <= a for _, y, z in taken):
            taken.append((name, a, b))
    return taken


def test_licences_beside_others_and_inside_lines():
    scan = licenses.Scanner(licenses.TEMPLATES, spans="words").scan
    lines = licenses.Scanner(licenses.TEMPLATES).scan
    two = ("This work is licensed under the GNU General Public License, version 3.\n\na\nb\n"
           "Work is licensed under the GNU General Public License, version 2 or later.")
    for found, dice in ((lines(two), 20 / 23), (scan(two), 20 / 21)):
        assert [(n, a, b) for n, _, a, b in found] == [("GPL-2.0", 5, 5), ("GPL-3.0", 1, 1)]
        assert [d for _, d, _, _ in found] == pytest.approx([dice, 1.0])
    inside = ("first\nCopyright 2020 Foo Bar Inc and many others who wrote it. Licensed under the MIT License. All of the "
              "rest was taken from elsewhere, and is\nreleased into the public\ndomain under CC0 1.0 by somebody else there.")
    assert scan(inside) == [("CC0-1.0", 1.0, 3, 4), ("MIT", 1.0, 2, 2)]
    assert [x[0] for x in lines(inside)] == ["CC0-1.0"]
    apache = " ".join(licenses.TEMPLATES["Apache-2.0"][1].split())
    assert [(n, a, b) for n, _, a, b in scan(f"x\n{apache} Released under the MIT License.")] == [("Apache-2.0", 2, 2), ("MIT", 2, 2)]
    rng = random.Random(4)
    short = [t for ts in licenses.TEMPLATES.values() for t in ts if len(t) < 110]
    for _ in range(12):
        text = " ".join(" ".join(x for x in rng.choice(short).split() if rng.random() < 0.95) + rng.choice(["", " word and more", "\n"])
                        for _ in range(4))
        assert {x[0] for x in scan(text)} == {x[0] for x in brute_words(text)}
    many = "\n".join(licenses.TEMPLATES["MIT"][3:] * 200)
    assert [(n, d) for n, d, _, _ in scan(many)] == [("MIT", 1.0)]


def test_neighbouring_licences_are_told_apart(spark):
    scan = licenses.Scanner(licenses.TEMPLATES, spans="words", tell_apart=True).scan
    names = lambda text: [x[0] for x in scan(text)]
    for text, want in (
            ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
            ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
            ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
            ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
            ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
            ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
            ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause")):
        assert names(f"Some words first. {text} And some behind.") == [want], text
    # no template for these: nothing rather than a neighbour
    for text in ("Licensed under the Apache License, Version 3.0.", "This work is licensed under a Creative Commons Attribution 2.5 Generic License.",
                 "Licensed under the GNU Library General Public License, version 4.", "Licensed under the BSD 4-Clause License."):
        assert names(text) == [], text
    for name, texts in licenses.TEMPLATES.items():  # every template is its own
        for t in texts:
            assert names(t) == [name]
    docs = spark.createDataFrame([(1, "Licensed under the Apache License, Version 1.1.")], DOCS)
    assert licenses.scan(docs, spans="words", tell_apart=True).first()["licenses"][0]["license"] == "Apache-1.1"


# -- language model --------------------------------------------------------------------
def brute_model(texts):
    big, seen = Counter(), Counter()
    for t in texts:
        w = ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})), "</s>"]
        big.update(zip(w, w[1:]))
        seen.update(w[1:])
    cont = Counter(b for _, b in big)
    by = defaultdict(list)
    for (a, _), c in big.items():
        by[a].append(c)
    d2 = lm.discounts(*[sum(c == k for c in big.values()) for k in (1, 2, 3, 4)])
    d1 = lm.discounts(*[sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)])
    cut = lambda c, d: max(0.0, c - (0, *d)[min(c, 3)])
    total = sum(cont.values())
    rest1 = sum(d1[min(c, 3) - 1] for c in cont.values()) / total

    def p(a, b):
        one = cut(cont[b], d1) / total + rest1 / (len(seen) + 1)
        if a not in by:
            return one
        n = sum(by[a])
        return cut(big[a, b], d2) / n + sum(d2[min(c, 3) - 1] for c in by[a]) / n * one
    return p, seen


def lm_texts():
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    weight = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(vocab, weight, k=rng.randint(1, 40))) for _ in range(150)]
    return texts + [texts[0].upper().replace("É", "é"), "", " \t", "a b"] + texts[:5]


def test_language_model_against_brute_force(spark):
    texts = lm_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b a"), (500, None), (501, "neverseen a b"), (502, "a " * 20_000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    train = docs.where(~lm.held_out(F.col("doc_id")))
    kept = [(t or "") for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    p, seen = brute_model(kept)
    n, v = sum(seen.values()), len(seen)
    for options in ({}, {"tokens_per_bucket": 3_000, "words_per_bucket": 1, "flush_words": 20}):
        model = lm.train(train, **options)
        assert (model.n_tokens, model.n_types) == (n, v)
        got = {r["doc_id"]: r for r in lm.score(docs.withColumn("score", F.lit("x")), model).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            w = ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), "</s>"]
            r = got[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) - 1, sum(seen[x] > 0 for x in w[1:]), n)
            assert r["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(w, w[1:])), rel=1e-9)
            assert r["base_score"] == pytest.approx(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w[1:]), rel=1e-9)
    # probabilities after a context sum to one, the unknown word included
    for a in ("<s>", "a", "b"):
        assert sum(p(a, b) for b in [*seen, "in no text"]) == pytest.approx(1.0)


def test_language_model_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    model = lm.train(docs.limit(0))
    r = lm.score(docs, model).first()
    assert (r["n_known"], r["train_tokens"], r["score"], r["base_score"]) == (0, 0, 0.0, 0.0)
    assert lm.score(docs.limit(0), model).count() == 0


def test_models_can_be_fitted_after_the_language_model(spark):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.linalg import Vectors
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lm_texts())], DOCS)
    assert lm.score(docs, lm.train(docs)).count() == docs.count()
    rows = spark.createDataFrame([(float(i % 2), Vectors.dense(i % 2, i)) for i in range(40)], ["label", "features"])
    for kind in (LogisticRegression(maxIter=3), RandomForestClassifier(numTrees=3, maxDepth=2, seed=1)):
        assert kind.fit(rows).transform(rows).where("label = prediction").count() == 40


def test_a_model_seen_in_part_is_an_error(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lm_texts())], DOCS)
    model = lm.train(docs, tokens_per_bucket=1_000)
    assert len(model.files["b"]) > 1
    hidden = min(model.files["b"])
    model.files["b"][hidden] += 8  # what a half-copied file looks like
    with pytest.raises(Exception, match="sees the model in part"):
        lm.score(docs, model).collect()
    model.files["b"] = {99: 8}  # a file that is not there
    with pytest.raises(Exception, match="sees the model in part"):
        lm.score(docs, model).collect()


def test_held_out_texts_score_above_the_base(spark, sf001):
    out = queries.QUERIES["op5_lm_score"](spark, sf001)
    r = out.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_packed_numbers():
    x = np.array([0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1], np.uint64)
    assert (lm._unvarint(lm._varint(x), len(x)) == x).all()
    k, c = lm._stretch(lm._squeeze(x, np.arange(8)))
    assert (k == x).all() and c.tolist() == list(range(8))
    assert len(lm._stretch(lm._squeeze(x[:0], x[:0]))[0]) == 0


# -- URL filter --------------------------------------------------------------------------
LINKED = [(1, "http://a.org/x", '<link rel="canonical" href="http://b.net/es/1">'),
          (2, "https://C.org/y/z#f", "<meta http-equiv='refresh' content='0; url=/q?a=1&amp;b=2'>"),
          (3, "https://c.org/q?a=1&b=2", '<link href="http://a.org/x" rel=canonical>'),
          (4, "http://d.com/", '<link rel=canonical href="http://a.org/x">'), (5, None, None), (6, "nourl", "x"),
          (7, "http://e.org/p", '<!-- <link rel=canonical href="http://a.org/x"> -->'), (8, "http://b.net/es/1", None),
          (9, "https://c.org/y/z", ""), (10, "http://WWW.Example.com/en/a?x", ""), (11, "http://example.com/en/", ""),
          (12, "http://sub.www.example.com/en/b", ""), (13, "http://example.com", ""), (14, "http://f.org/a/b", '<link rel=canonical href="c">'),
          (15, "http://f.org/a/c", '<link rel=stylesheet href="http://a.org/x">'), (9, "https://c.org/y/z", "")]


def test_url_rules_and_aliases(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    pages = spark.createDataFrame(LINKED, PAGES)
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect())
    verdict = {r[0]: (r[3], r[4]) for r in got}
    assert verdict == {
        1: (None, "block"), 2: (None, "block"), 3: (None, "block"), 4: ("com/", "allow"), 5: (None, "allow"),
        6: (None, "allow"), 7: (None, "allow"), 8: ("net/es/", "block"), 9: (None, "block"),
        10: ("www.example.com/en/", "allow"), 11: ("example.com/en/", "block"), 12: ("www.example.com/en/", "allow"),
        13: (None, "allow"), 14: (None, "allow"), 15: (None, "allow")}
    assert len(got) == len(LINKED)
    assert [r[1:3] for r in got if r[0] in (5, 6, 10, 13)] == [("", ""), ("", ""), ("www.example.com", "/en/a"), ("example.com", "")]
    cleared = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules, allow_scope="class").collect()}
    assert cleared[1] == cleared[2] == "allow" and cleared[8] == "block"
    more = spark.createDataFrame([("http://e.org/p#x", "http://b.net/es/1")], "u string, v string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules, edges=more).collect()}[7] == "block"
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}
    far = urls.match_rules(pages.select("page_id", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path")),
                           rules, max_broadcast=0)
    assert {r["page_id"]: r["rule"] for r in far.collect()} == {k: v[0] for k, v in verdict.items()}


# -- main text -----------------------------------------------------------------------------
SHELL = ('<html><head><title>T t</title><script>var x="<article>no</article>";</script></head><body>{before}'
         "<article><h1>Head &amp; line</h1>{body}</article>{after}</body></html>")
NAV = '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>'


def test_main_text_of_fixtures(spark):
    body = "<p>First <b>bold</b>word\n  here.<br>next</p><div class='ad'>Buy now, many many words of it</div><p>Last</p>"
    want = "Head & line\nFirst boldword here. next\nLast"
    pages = [SHELL.format(before=NAV + "<header>Site name</header>", body=body, after="<footer>&copy; foot words and more</footer>"),
             SHELL.format(before='<div class="cookie-notice">We use cookies, many many of them, and more.</div>', body=body,
                          after='<section id="comments"><article class="comment"><p>A reader says a lot of words here.</p></article></section>'),
             SHELL.format(before="<aside>Side bar</aside><form><label>Mail</label><input></form>", body=body, after='<div class="related">More stories</div>')]
    weights = maintext.learn(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], PAGES))
    for p in pages:
        assert maintext.main_text(p, weights) == want
        assert maintext.main_text(p, {}) == want  # the prior alone
    cut = pages[0][:pages[0].index("Last") + 2]
    assert maintext.main_text(cut, weights).endswith("\nLa")
    assert maintext.main_text(pages[0].replace("</p>", "").replace("</article>", ""), weights).startswith("Head & line\nFirst")
    plain = "<body>" + NAV + "<div id=page><p>Some words in a page without marks.</p><p>One</p></div><div class=footer>Foot</div>"
    assert maintext.main_text(plain, weights) == "Some words in a page without marks.\nOne"
    long = SHELL.format(before=NAV, body="<p>" + "word " * 50_000 + "</p>" * 3 + "<p>x</p>" * 5_000, after="")
    assert maintext.main_text(long, weights).count("\n") == 5_001
    rows = [(1, "u", pages[0]), (1, "u", pages[0]), (2, None, None), (3, "u", ""), (4, "u", "<nav>only</nav>"), (5, "u", "a < b &lt; c")]
    frame = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("mine"))
    got = sorted((r["page_id"], r["text"]) for r in maintext.extract(frame, weights).collect())
    assert got == [(1, want), (1, want), (2, ""), (3, ""), (4, ""), (5, "a < b < c")]
    assert maintext.learn(frame.limit(0)) == {}


def test_names_of_article_parts_are_not_dropped(spark):
    parts = ('<div class="entry-header"><h1>Title</h1></div><div class="article-header">Lead</div><h2 id="side-effects">Side effects</h2>'
             '<section id="related-work"><p>Others did it.</p></section><div class="social-history"><p>Past.</p></div>'
             '<div id="form-and-function"><p>Shape.</p></div><div class="no-sidebar post"><p>Rest of it.</p></div>')
    want = "Title\nLead\nSide effects\nOthers did it.\nPast.\nShape.\nRest of it."
    wide = '<body class="has-sidebar"><div class="with-sidebar">{}</div></body>'
    labelled = ["<body>" + NAV + f'<div class="sidebar-layout"><article>{parts}</article></div><div class="foo-footer-x">Foot words</div>'] * 30
    weights = maintext.learn(spark.createDataFrame([(i, "u", p) for i, p in enumerate(labelled)], PAGES))
    for w in (weights, {}):
        assert maintext.main_text(f"<body>{NAV}<article>{parts}</article></body>", w) == want
        assert maintext.main_text(wide.format("<p>Some words in a page.</p>"), w) == "Some words in a page."
        assert maintext.main_text(wide.format(f"<article>{parts}</article>"), w) == want
        # comments and teasers do not end what they stand in
        said = '<section id="comments"><article class="c1"><p>A reader says a lot of words here.</p></article></section>'
        assert maintext.main_text(f"<article><p>Text of it.</p>{said}</article>", w) == "Text of it."
        assert maintext.main_text(f"<article><p>Text of it.</p></article>{said}", w) == "Text of it."
        teaser = "<aside><article><p>Another story, to be read elsewhere.</p></article></aside>"
        assert maintext.main_text(f"<main><p>Text of it.</p>{teaser}<p>End.</p></main>", w) == "Text of it.\nEnd."
    assert weights["@ div foo-footer-x"] < maintext.LEFT_OUT < weights["@ div sidebar-layout"] == 0
    plain = '<body><div class="sidebar-layout"><p>Words of the page.</p><div class="foo-footer-x">Foot words and many more</div></div>'
    assert maintext.main_text(plain, weights) == "Words of the page."


def test_forms_around_a_page_and_forms_in_it():
    body = "<h1>Title</h1><p>Words of the article, and some more.</p>"
    state = "<input type='hidden' name='state' value='x'>"
    assert maintext.main_text(f"<body><form id='aspnetForm'>{body}</form></body>", {}) == "Title\nWords of the article, and some more."
    assert maintext.main_text(f"<body><form id='f' class=main>{state}{body}</form></body>", {}).endswith("and some more.")
    signup = "<form><label>Your mail, please, for many more letters</label><input name=m><button>Go on</button> No spam</form>"
    want = "Title\nWords of the article, and some more."
    assert maintext.main_text(f"<body><article>{body}{signup}</article></body>", {}) == want
    assert maintext.main_text(f"<body><form>{state}<article>{body}</article><select><option>One</select><input name=q></form>", {}) == want
    long = " ".join(["word"] * 60)
    assert maintext.main_text(f"<body><form><p>{long}</p><input name=q></form></body>", {}) == long


def test_best_region_against_brute_force():
    rng = random.Random(13)
    for _ in range(300):
        score = [rng.choice([-2.0, -1.0, -0.5, 0.0, 1.0, 3.0]) for _ in range(rng.randint(0, 14))]
        a, b = maintext.best_region(score)
        every = [(sum(score[i:j]), -i) for i in range(len(score)) for j in range(i + 1, len(score) + 1)]
        assert sum(score[a:b]) == max([0.0, *(x for x, _ in every)])
    page = "<body>" + NAV + "<p>One two three</p><ul><li>x</li></ul><p>four five</p><div><div><div>far</div></div></div>"
    rows = list(maintext.tokens(page, {}))
    score = maintext.scores(rows, {})
    a, b = maintext.best_region(score)
    assert sum(score[a:b]) == max(sum(score[i:j]) for i in range(len(score)) for j in range(i, len(score) + 1))


def test_unbalanced_tags_take_linear_time():
    import time
    took = []
    for n in (4_000, 32_000):
        began = time.process_time()
        assert maintext.main_text("<p>word</p>" + "<div>" * n + "</x>" * n + "</div>" * n, {}) == "word"
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.02)  # eight times the tags; the square would be 64 times


def test_icons_and_formulas_do_not_swallow_the_page():
    fill = "and some more words of text"
    for icon in ('<svg-icon name="x"></svg-icon>', "<math-formula></math-formula>", "<style-guide></style-guide>", '<svg width="1"/>',
                 '<svg class="nav-icon"><title>Icon</title><path d="M0 0"/></svg>', "<svg><g>", "<template>", "<iframe src='x>y'>",
                 "<textarea rows=2>", "<title>", "<script-x></script-x>"):
        assert maintext.main_text(f"<body>{NAV}<article><p>one</p>{icon}<p>two</p></article></body>", {}) == "one\ntwo", icon
        assert maintext.main_text(f"<body><p>one {fill}</p>{icon}<p>two {fill}</p></body>", {}) == f"one {fill}\ntwo {fill}", icon
    formula = "<p>So <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> holds.</p>"
    chart = "<svg><style>a{}</style><text>North</text><text>South</text></svg>"
    assert maintext.main_text(f"<article>{formula}{chart}<p>End</p></article>", {}) == "So E=mc2 holds.\nNorth South\nEnd"
    assert maintext.main_text("<p>one</p><style>p{}</style><script>x<p>no</p>", {}) == "one"
    many = "<article><p>one</p>" + "<title>" * 20_000 + "<p>two</p></article>"  # the end is looked for once
    assert maintext.main_text(many, {}).endswith("two")


def test_main_text_of_the_given_pages(spark, sf001):
    import html
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op9_main_text"](spark, sf001).collect()}
    for r in spark.read.parquet(f"{sf001}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        inner = re.sub(r"</?b>|<br>", "", inner)
        blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*(?:>|\Z)", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


# -- quality rules ---------------------------------------------------------------------------
def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if win[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_statistics_against_brute_force(spark):
    rng = random.Random(13)
    texts = [None, "", " \n\t", "é#\n\né#\n x \n x ", "a\x0bb\x1cc d e", "a b c d e f " * 3, "w " * 30_000, "a " * 7]
    for _ in range(120):
        vocab = [rng.choice("abcé#") * rng.randint(1, 2) for _ in range(rng.randint(1, 12))]
        texts.append("".join(rng.choice(vocab) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(rng.randint(1, 80))))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, stats int")
    for r in quality.judge(docs, []).collect():
        want = brute_counts(texts[r["doc_id"]])
        assert tuple(r["stats"][c] for c in quality.COUNTS[:5]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (not r["base_failed"]) and r["rule"] == 0
    assert quality.judge(docs.limit(0), []).count() == 0


def test_decision_list_is_learned_and_ordered(spark):
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.7) & (x[:, 1] <= 0.4)) | (x[:, 2] > 0.95)
    noisy = y ^ (rng.random(3000) < 0.01)
    rules = quality.fit_rules(list("abcd"), x, noisy)
    new = rng.random((3000, 4))
    want = ((new[:, 0] > 0.7) & (new[:, 1] <= 0.4)) | (new[:, 2] > 0.95)
    got = np.zeros(3000, bool)
    for r in rules:
        got |= quality._covers(r, list("abcd"), new)
    assert (got == want).mean() > 0.97 and len(rules) >= 2
    frame = spark.createDataFrame([tuple(map(float, v)) for v in new[:300]], "a double, b double, c double, d double")
    number = [r[0] for r in frame.select(quality.rule_column(rules, {k: F.col(k) for k in "abcd"})).collect()]
    first = [next((i for i, r in enumerate(rules, 1) if quality._covers(r, list("abcd"), new[k:k + 1])[0]), 0) for k in range(300)]
    assert number == first
    assert quality.fit_rules(["a"], np.zeros((0, 1)), np.zeros(0, bool)) == []
    assert quality.fit_rules(["a"], np.ones((50, 1)), np.arange(50) % 2 == 0) == []


def test_quality_labels_are_met_on_other_rows():
    """Rules learned at one size hold on the labelled documents of another."""
    from pagelab.session import local_session
    spark = local_session("*", shuffle_partitions=8, app="pagelab-tests")
    read = lambda sf, t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")
    rules = quality.learn(read("sf0.1", "documents"), read("sf0.1", "labels"))
    out = quality.judge(read("sf0.01", "documents"), rules).join(read("sf0.01", "labels"), "doc_id").where(~F.col("base_failed"))
    n = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.1 * (n.get((0, False), 0) + n.get((0, True), 0))
    empty = quality.learn(read("sf0.01", "documents"), read("sf0.01", "labels").limit(0))
    assert empty == []


def test_repeated_labelled_documents_weigh_as_often_and_travel_once(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(i, good + f" more{i}") for i in range(40)] + [(100 + i, "!!! ### " * 3 + good) for i in range(40)] + [(100, "!!! ### " * 3 + good)] * 3_000
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0) for i, _ in rows[:80]], "doc_id long, quality int")
    rules = quality.learn(docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, rules).collect()}
    assert all(v == (i < 100) for i, v in kept.items())
    x = np.array([[0.1], [0.2], [0.8], [0.9]])
    y = np.array([False, False, True, True])
    counts = np.array([9, 8, 7, 11])
    many = np.repeat(np.arange(4), counts)
    cut = [np.array([0.15, 0.5, 0.85])]
    one = quality._best_condition(["f"], x, y, counts.astype(float), cut)
    assert one == quality._best_condition(["f"], x[many], y[many], np.ones(len(many)), cut) == quality.Condition("f", ">", 0.5)


def test_statistics_are_read_below_no_filter(spark):
    docs = spark.createDataFrame([(1, "a b c")], DOCS)
    labelled = docs.join(F.broadcast(docs.select("doc_id", F.lit(0).alias("_y"))), "doc_id")
    rows = labelled.select("_y", quality.stats_udf.asNondeterministic()(F.col("text").cast("binary")).alias("stats"))
    plan = rows.where(~quality.base_failed())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("stats_udf") == 1 and plan.index("stats_udf") < plan.index("Join")


def test_pages_that_fail_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 12 + "a b c d e f g h i j k", 5), (2, "short", 6)], "doc_id long, text string, _stats int")
    out = quality.keep_good(docs, [])
    assert out.columns == docs.columns
