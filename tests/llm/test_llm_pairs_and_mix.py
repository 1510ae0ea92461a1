"""Decontamination, SimHash, components, mix and the pipeline against brute force."""

import hashlib
import random
import re
import shutil
import tempfile
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from pagelab.llm import components, decontaminate, mix, queries, quality, simhash
from pagelab.llm.common import lower_az

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BENCH = "item_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def doc_rows(texts):
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_hits(text, items, width=10):
    w = alnum_words(text)
    hit, ids = set(), set()
    for i, t in items:
        g = alnum_words(t)
        n = min(width, len(g))
        for a in range(len(g) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p:p + n] == g[a:a + n]:
                    hit |= set(range(p, p + n))
                    if i is not None:
                        ids.add(i)
    return len(w), len(hit), ids


def bench_case():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé7") for _ in range(rng.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 30)))) for i in range(8)]
    items += [(8, "Short ITEM"), (9, None), (10, "..."), (3, items[4][1]), (None, items[5][1]), (8, "Short ITEM")]
    texts = [None, "", "!!", "short item here, short-item.", "x" * 5000, " ".join(word() for _ in range(400))]
    for i, t in items[:8]:
        w = t.split()
        texts.append("Pre fix " + t.upper().replace("É", "é") + " suffix")
        texts.append(" ".join(word() for _ in range(30)) + "\n" + ", ".join(w[2:13]) + "; " + " ".join(w[-11:]))
        texts.append(" ".join(w[:9]) + " zz " + " ".join(w[9:]))
    return items, texts


def test_decontamination_against_brute_force(spark):
    items, texts = bench_case()
    rows = doc_rows(texts) + doc_rows(texts)[:4] + [(None, texts[7], None, None, None)]
    docs, bench = frame(spark, rows), frame(spark, items, BENCH)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"])
                  for r in decontaminate.report(docs, bench).collect())
    want = Counter()
    for r in rows:
        n, hit, ids = brute_hits(r[1], items)
        want[r[0], n, hit, tuple(sorted(ids)), hit > 0] += 1
    assert got == want
    # the same rows when the set is joined by a shuffle
    keys = {"doc_id": F.col("doc_id"), "_row": F.monotonically_increasing_id()}
    far = decontaminate.scan(docs, bench, keys, max_broadcast=0)
    assert Counter(r["n_hit"] for r in far.collect()) == Counter(x[2] for x in want.elements())


def test_decontamination_removes_documents_or_spans(spark):
    items, texts = bench_case()
    docs = frame(spark, doc_rows(texts)).withColumns({"_key": F.lit(1), "spans": F.lit("s"), "_text_key": F.lit("k")})
    bench = frame(spark, items, BENCH)
    bad = {i for i, t in enumerate(texts) if brute_hits(t, items)[1]}
    for limit in (0, 1000):
        out = decontaminate.decontaminate(docs, bench, max_broadcast_rows=limit)
        assert out.columns == docs.columns
        assert sorted(r["doc_id"] for r in out.collect()) == [i for i in range(len(texts)) if i not in bad]
        cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, remove="spans", max_broadcast_rows=limit).collect()}
        for i, t in enumerate(texts):
            if i not in bad:
                assert cut[i] == t
            else:
                n, hit, _ = brute_hits(t, items)
                assert len(alnum_words(cut[i])) == n - hit
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, remove="lines")


def test_decontamination_empty_tables(spark):
    docs = frame(spark, doc_rows(["a b"]))
    none, no_items = frame(spark, []), frame(spark, [], BENCH)
    assert decontaminate.report(none, no_items).count() == 0
    assert [r["n_hit"] for r in decontaminate.report(docs, no_items).collect()] == [0]
    assert decontaminate.decontaminate(docs, no_items).count() == 1
    assert decontaminate.decontaminate(none, frame(spark, [(1, "a")], BENCH)).count() == 0


def test_lower_az_folds_only_ascii(spark):
    got = spark.createDataFrame([("AZaz ÉÀİ",), ("PLAIN",), (None,)], "t string").select(lower_az(F.col("t"))).collect()
    assert [r[0] for r in got] == ["azaz ÉÀİ", "plain", None]


def brute_fingerprint(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return 0
    s = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(3))
    out = [None, "", " \n", "one", "One", "two words", "Ünïcode Text HERE now", "ünïcode text here now"]
    for _ in range(12):
        base = [word() for _ in range(200)]
        out.append(" ".join(base))
        for _ in range(6):
            other = list(base)
            other[rng.randrange(200)] = word()
            out.append(" ".join(other))
    return out + out[:12] + ["long " * 30_000]


def test_fingerprints_and_classes(spark):
    texts = near_texts()
    rows = doc_rows(texts) + [(3, "one", "en", "s", 3)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    ids = brute_classes(fps)
    want = Counter((r[0], f, rows[c][0]) for r, f, c in zip(rows, fps, ids))
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component"]) for r in got) == want


def test_links_survive_small_chunks(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(150):  # a dense group, a chain, and strangers
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), 2)))
    chain = rng.getrandbits(64)
    for b in range(0, 60, 4):
        chain ^= 0b1111 << b
        fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    want = brute_classes(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for chunk in (4, 64, 4096):
        links = simhash.links(spark.createDataFrame(signed, "fp long"), 4, chunk=chunk)
        found = dict(components.components(links).collect())
        groups, expected = defaultdict(set), defaultdict(set)
        for f, (s,), w in zip(fps, signed, want):
            groups[found.get(s, s)].add(f)
            expected[w].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_keep_one_of_each_class(spark):
    texts = near_texts()
    rows = doc_rows(texts) + [(3, "one", "en", "s0", 3), (None, "alone and lost in here", None, None, None), (5, "another text of id five", "x", "y", 1)]
    docs = frame(spark, rows).withColumns({"fp": F.lit(1), "_keep_id": F.lit("x"), "component": F.lit(0)})
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    got = out.collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    ids = brute_classes(fps)
    assert len(got) == len(set(ids))
    kept = Counter((r["doc_id"], r["text"]) for r in got)
    assert set(kept.values()) == {1}
    best = defaultdict(list)
    for r, c in zip(rows, ids):
        best[c].append((r[0] is None, r[0]))
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(min(v)[1]) for v in best.values())
    assert simhash.keep_one(frame(spark, [])).count() == 0
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 3000 + i) for i in range(50)] + [(7, 7), (5000, 5000)]
    got = dict(components.components(spark.createDataFrame(edges + [(None, 3), (4, None)], "u long, v long")).collect())
    label = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                moved = True
    assert got == label
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame(edges, "u long, v long"), max_steps=1).count()


def brute_targets(per_source, share=1.5, weights=(5, 2, 1), epochs=2):
    order = sorted(per_source, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, free = share * sum(per_source.values()), {}, set(order)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > epochs * per_source[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = epochs * per_source[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def mix_rows():
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        s = rng.choice(["a", "a", "a", "b", "é", "B", None, "tiny"]) if i else "tiny"
        n = 0 if i % 50 == 0 else rng.randint(1, 40)
        if s == "tiny" and i:
            s = "c"
        rows.append((i, None if i % 97 == 0 else " ".join(["w"] * n), "en", s, n))
    return rows + [rows[5], rows[5], rows[6]] + [(10_000, "w " * 30_000, "en", "a", 1)]


def test_mix_targets_and_takes(spark):
    rows = mix_rows()
    docs = frame(spark, rows)
    opts = {"block_words": 64, "shards": 8, "rows_per_range": 100}
    out = mix.plan(docs, **opts).collect()
    assert len(out) == len(rows)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len((t or "").split())
    want = brute_targets(dict(size))
    taken = Counter()
    longest = defaultdict(int)
    for r in out:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert len(r["copies"]) <= 2
        taken[r["source"]] += r["size"] * len(r["copies"])
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1
    again = mix.plan(docs.repartition(3), **opts).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mix_rows_and_shards(spark):
    rows = mix_rows()
    docs = frame(spark, rows).withColumns({"shard": F.lit("mine"), "_copies": F.lit(1), "h": F.lit(2)})
    opts = {"block_words": 64, "shards": 4}
    out = mix.mix(docs, **opts)
    assert out.columns == [*docs.columns, "shard_", "epoch", "order_key"]
    planned = Counter()
    for r in mix.plan(docs, **opts).collect():
        for c in r["copies"]:
            planned[r["doc_id"], c["epoch"], c["shard"]] += 1
    got = out.collect()
    assert Counter((r["doc_id"], r["epoch"], r["shard_"]) for r in got) == planned
    words = Counter()
    for r in got:
        words[r["shard_"]] += len((r["text"] or "").split())
    typical = sorted(words.values())[1]
    assert set(words) == {0, 1, 2, 3} and min(words.values()) > 0.4 * typical


def test_mix_without_words(spark):
    assert mix.plan(frame(spark, [])).count() == 0
    assert mix.mix(frame(spark, [])).count() == 0
    out = mix.plan(frame(spark, doc_rows([None, "", " "]))).collect()
    assert [(r["size"], r["target"], r["size"] * len(r["copies"])) for r in out] == [(0, 0.0, 0)] * 3


def test_splitting_tree_keeps_quotas_and_draws_hypergeometrically(spark):
    import math
    quotas = [1000, 500, 20, 0, 7, 3001]
    q = spark.createDataFrame(list(enumerate(quotas)), "idx int, quota long")
    rows = mix.split_tree(q, 8, seed=1).collect()
    per, shard = Counter(), Counter()
    for r in rows:
        assert r["n"] >= 0
        per[r["idx"]] += r["n"]
        shard[r["shard"]] += r["n"]
    assert [per[i] for i in range(len(quotas))] == quotas
    assert max(shard.values()) - min(shard.values()) <= 1
    draw = mix.hypergeometric("50", "20", "18", "u")
    got = dict(spark.range(20_000).selectExpr("(id + 0.5D) / 20000 AS u").selectExpr(f"{draw} AS x").groupBy("x").count().collect())
    for x in range(19):
        p = math.comb(20, x) * math.comb(30, 18 - x) / math.comb(50, 18) * 20_000
        assert abs(got.get(x, 0) - p) <= 1.5
    with pytest.raises(ValueError):
        mix.split_tree(q, 6, seed=1)


def stage_dir(spark, docs, labels, bench):
    d = tempfile.mkdtemp()
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = prose(25)
    texts = [prose(80) for _ in range(60)]
    texts += [" ".join(w + "###" for w in prose(60).split()) for _ in range(30)]  # junk
    texts += [texts[3], texts[4], texts[4] + " zzz", prose(40) + " " + item[:120] + " " + prose(30), "too short", None]
    docs = frame(spark, doc_rows(texts))
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    d = stage_dir(spark, docs, labels, frame(spark, [(0, item)], BENCH))
    try:
        assert [n for n, _ in corpus_pipeline.STAGES] == [
            "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "mix_sources"]
        now = spark.read.parquet(f"{d}/documents.parquet")
        seen = []
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, now, d)
            if k < 3:
                assert out.columns == docs.columns
            out.write.parquet(f"{d}/{k}")
            now = spark.read.parquet(f"{d}/{k}")
            seen.append([r.asDict() for r in now.collect()])
        good = {i for i, t in enumerate(texts) if t and len(t.split()) >= 10 and "###" not in t
                and 100 * quality.repeat_words(t.encode().split()) <= 20 * len(t.split())}
        assert {r["doc_id"] for r in seen[0]} == good
        order = sorted(good)
        classes = brute_classes([brute_fingerprint(texts[i]) for i in order])
        assert sorted(r["doc_id"] for r in seen[1]) == sorted({order[c] for c in classes})
        clean = [r["doc_id"] for r in seen[1] if not brute_hits(r["text"], [(0, item)])[1]]
        assert sorted(r["doc_id"] for r in seen[2]) == sorted(clean) and 93 not in clean
        assert {r["doc_id"] for r in seen[3]} <= set(clean)
        total = sum(len(r["text"].split()) for r in seen[2])
        assert abs(sum(len(r["text"].split()) for r in seen[3]) - 1.5 * total) <= 3 * 80
        assert corpus_pipeline.run(spark, d).count() == len(seen[3])
    finally:
        shutil.rmtree(d)


def test_op1_digest(spark, sf001):
    items = [tuple(r) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in queries.QUERIES["op1_decontamination"](spark, sf001).collect()}
    for r in spark.read.parquet(f"{sf001}/documents.parquet").collect():
        n, hit, ids = brute_hits(r["text"], items)
        got = rows[r["doc_id"]]
        joined = ",".join(sorted(map(str, ids)))
        assert (got["n_words"], got["n_hit"], got["n_items"], got["contaminated"]) == (n, hit, len(ids), hit > 0)
        assert got["items_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
