"""Hand-computed one-row fixtures for the quirks of each operator family."""

import math

import pytest
from pyspark.sql import functions as F

from pagelab.functions import dom as DF, html as H, url as U
from pagelab.operators import clean, dom, evaluate as EV, features, labels, sample, scale, text as T


def one(spark, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} string" for n in names))


def test_path_depth_variants(spark):
    df = one(spark, url="http://a.b/")
    s = df.select(U.structural_url_features("url")["url_path_depth"].alias("s"),
                  U.lexical_url_features("url")["url_path_depth"].alias("l"),
                  U.manual_url_features("url")["m_depth"].alias("m")).first()
    assert (s.s, s.l, s.m) == (1, 1, 0)


def test_no_scheme_and_scheme_like_host(spark):
    df = spark.createDataFrame([("a.b.c.d/x",), ("httpfoo.com",)], "url string")
    r = df.select(U.netloc(U.with_http("url")).alias("n"),
                  U.structural_url_features("url")["url_num_subdomains"].alias("sub")).collect()
    assert r[0].n == "a.b.c.d" and r[0].sub == 2
    assert r[1].n == ""  # starts with "http", so no prefix, and no "://"


def test_entropy(spark):
    assert one(spark, s="aabb").select(U.shannon_entropy("s").alias("e")).first().e == pytest.approx(1.0)
    assert one(spark, s="").select(U.shannon_entropy("s").alias("e")).first().e == 0.0


def test_manual_double_slash(spark):
    r = one(spark, url="http://a.b/x//y").select(U.manual_url_features("url")["m_double_slash"].alias("d")).first()
    assert r.d == 1


def test_empty_link_quirk(spark):
    df = one(spark, html='<a href="/x">a</a><a href="/x">b</a>')
    hl = F.lower("html")
    r = df.select(H.empty_link_ratio(hl, "compat").alias("c"), H.empty_link_ratio(hl, "intent").alias("i")).first()
    assert (r.c, r.i) == (1.0, 0.0)


def test_external_link_ratio(spark):
    df = one(spark, html='<a href="http://z.com">z</a><a href="/l">l</a>', d="a.b")
    assert df.select(H.external_link_ratio(F.lower("html"), F.col("d")).alias("r")).first().r == 0.5


def _tree(spark, url, html):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return features.tree_features(df).first()


def test_external_resources(spark):
    r = _tree(spark, "http://a.b/", '<html><body><img src="http://cdn/x"><script src="/a"></script></body></html>')
    assert r.external_resource_ratio == 0.5


def test_foreign_form(spark):
    inner = _tree(spark, "http://a.b/", '<html><body><form action="http://sub.a.b/"></form></body></html>')
    outer = _tree(spark, "http://a.b/", '<html><body><form action="http://z.com/"></form></body></html>')
    assert (inner.foreign_form_action, outer.foreign_form_action) == (0, 1)


def test_zones(spark):
    df = spark.createDataFrame([(1, "<a><b><c><d><e><f><g>"), (2, "<a>")], "page_id long, html string")
    r = {x.page_id: x for x in dom.spatial_zones(df).collect()}
    assert (r[1].zone1_size, r[1].zone2_size, r[1].zone3_size) == (2, 2, 3)
    assert (r[2].zone1_size, r[2].zone2_size, r[2].zone3_size) == (1, 0, 0)


def test_xpath_and_script_decoy(spark):
    df = spark.createDataFrame([(1, "<html><body><div><p></p></div></body></html>"),
                                (2, '<html><body><script>var t="</p>";</script><div><p></p></div></body></html>')],
                               "page_id long, html string")
    r = {x.page_id: x.xpath_seq for x in dom.xpath_sequence(df).collect()}
    assert r[1] == "<body> <body/div> <body/div/p>"
    assert r[2] == "<body> <body/script> <body/div> <body/div/p>"
    t = features.tree_features(df.withColumn("url", F.lit("http://a.b/"))).collect()
    assert {x.page_id: x.dom_depth for x in t} == {1: 3, 2: 3}


def test_implied_p_close(spark):
    df = spark.createDataFrame([(1, "<html><body><p>a<p>b<div>c</div></body></html>")], "page_id long, html string")
    assert dom.xpath_sequence(df).first().xpath_seq == "<body> <body/p> <body/p> <body/div>"


@pytest.mark.parametrize("html, repaired, plain", [
    ("<ul><li>a<li>b<li>c</ul>", "<li> <li> <li>", "<li> <li/li> <li/li/li>"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "<tr> <tr/td> <tr/td> <tr> <tr/td>",
     "<tr> <tr/td> <tr/td/td> <tr/td/td/tr> <tr/td/td/tr/td>"),
    ("<ul><li>a<ul><li>x<li>y</ul><li>b</ul>", "<li> <li/ul> <li/ul/li> <li/ul/li> <li>",
     "<li> <li/ul> <li/ul/li> <li/ul/li/li> <li/li>"),
    ("<select><option>1<option>2</select>", "<option> <option>", "<option> <option/option>"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dt> <dd> <dt>", "<dt> <dt/dd> <dt/dd/dt>"),
    ("<div><p>a<b>b<p>c</div>", "<p> <p/b> <p>", "<p> <p/b> <p/b/p>"),
    ("<table><tr><td><p>a<table><tr><td>b</table><p>c</table>",
     "<tr> <tr/td> <tr/td/p> <tr/td/table> <tr/td/table/tr> <tr/td/table/tr/td> <tr/td/p>",
     "<tr> <tr/td> <tr/td/p> <tr/td/p/table> <tr/td/p/table/tr> <tr/td/p/table/tr/td> <tr/td/p/p>"),
    ("<my-card><x-foo></x-foo></my-card>", "<x-foo>", "<x-foo>"),
    ('<div><a title="x>y"><b></b></a></div>', "<a> <a/b>", "<a> <a/b>"),
    ("<div><a href=http://z.c/>hi<b></b></a></div>", "<a> <a/b>", "<a> <a/b>"),
    ("<div><x-y/><br/><i a='1'/><u></u></div>", "<x-y> <br> <i> <u>", "<x-y> <br> <i> <u>"),
])
def test_implied_end_tags_in_both_modes(spark, html, repaired, plain):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert dom.xpath_sequence(df).first().xpath_seq == repaired
    assert dom.xpath_sequence(df, mode="plain").first().xpath_seq == plain


def test_many_tags_keep_their_order(spark):
    df = spark.createDataFrame([(1, "<div>" + "<p>a" * 700 + "</div>")], "page_id long, html string")
    r = dom.xpath_sequence(df).first()
    assert r.n_paths == 700 and set(r.xpath_seq.split(" ")) == {"<p>"}
    assert dom.xpath_sequence(df, mode="plain").first().xpath_seq.split(" ")[299].count("p") == 300


def test_visible_text_decodes_references(spark):
    df = spark.createDataFrame([("<p>caf&eacute; a&nbsp;b &#233;c&#xA0;d &amp e</p>",)], "html string")
    assert df.select(H.visible_text("html")).first()[0] == "caf a b c d amp e"
    df = spark.createDataFrame([("<p>th&#101; &#x45;&#110;D &#0065;&#x6a; &amp;#101; &#200; &#1010;</p>",)], "html string")
    assert df.select(H.visible_text("html")).first()[0] == "the end aj"
    text = df.select(F.lit(1).alias("page_id"), F.lit("<b>&eacute;&nbsp;</b>").alias("html"))
    assert dom.advanced_html_features(text).first().text_to_code_ratio == pytest.approx(1 / 21)


def test_knn_in_blocks_is_exact(spark):
    import numpy as np
    from pagelab.operators import models
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 4, (300, 3)).astype(float), rng.integers(0, 3, 300)
    df = spark.createDataFrame([(i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "vec_id long, embedding array<double>, label int")
    train, test = df.where("vec_id < 250"), df.where("vec_id >= 250")
    for rows in (10_000, 60):
        got = {r.vec_id: (r.prediction, r.share_1) for r in models.knn_classify(train, test, 5, block_rows=rows).collect()}
        assert len(got) == 50
        for i in range(250, 300):
            d = ((x[:250] - x[i]) ** 2).sum(axis=1)
            near = y[:250][np.argsort(d, kind="stable")[:5]]
            assert got[i] == (int(np.bincount(near).argmax()), pytest.approx((near == 1).mean()))


def test_checkpoint_folder_is_required_off_local_mode(monkeypatch):
    from pagelab import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_idf(spark):
    df = spark.createDataFrame([(1, ["x"]), (2, ["y"]), (3, ["y"])], "page_id long, g array<string>")
    v = {r.term: r.idf for r in T.tfidf_fit(df, "page_id", "g", 10).collect()}
    assert v["x"] == pytest.approx(math.log(4 / 2) + 1)
    w = T.tfidf_transform(df, "page_id", "g", T.tfidf_fit(df, "page_id", "g", 10)).collect()
    assert all(r.weight == pytest.approx(1.0) for r in w)  # one term per document -> unit norm


def test_zscore_constant_and_p99(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)], "c double, x double")
    z = scale.zscore_apply(df, scale.zscore_fit(df, ["c"]), ["c"]).collect()
    assert [r.c for r in z] == [0.0, 0.0, 0.0]
    ub = scale.clip_fit(df, ["x"], 0.99).first()["x__ub"]
    assert ub == pytest.approx(2.98)


def test_label_policies(spark):
    df = spark.createDataFrame([(0, None), (1, "Malware")], "page_id long, category string")
    r = df.select(labels.label_standardise("category").alias("s"), labels.label_pipeline_map("category").alias("p")).collect()
    assert [x.s for x in r] == [0, 1]
    assert [x.p for x in r] == [None, None]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5), (0, 0.2), (1, 0.9)], "label int, prob double")
    assert EV.roc_auc(df).first().roc_auc == pytest.approx(0.875)
    # AUC(score) + AUC(-score) = 1
    neg = EV.roc_auc(df.withColumn("prob", -F.col("prob"))).first().roc_auc
    assert 0.875 + neg == pytest.approx(1.0)


def test_threshold_strictness(spark):
    df = spark.createDataFrame([(0.5,)], "p double")
    r = df.select(EV.threshold_predict("p", 0.5).alias("s"), EV.threshold_predict("p", 0.5, strict=False).alias("n")).first()
    assert (r.s, r.n) == (0, 1)


def test_sweeps_by_cells_equal_direct_counts(spark):
    import random
    from pagelab.operators import evaluate as EV
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([0, 1, 1, None]), rng.choice([rng.random(), rng.choice([0.0, 0.5, 1.0]), None])) for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, label int, prob double")
    for strict in (True, False):
        for ts in ([0.5], [0.9, 0.1, 0.5, 0.25], [i / 49 for i in range(50)]):
            got = {(r["g"], r["threshold"]): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in
                   EV.threshold_sweep(df, ts, strict=strict, groups=["g"]).collect()}
            for g in "ab":
                for t in ts:
                    hit = lambda p: p is not None and (p > t if strict else p >= t)  # noqa: E731,B023
                    n = lambda y, h: sum(1 for a, b, p in rows if a == g and b == y and hit(p) == h)  # noqa: E731,B023
                    assert got[g, t] == (n(1, True), n(0, True), n(1, False), n(0, False))


def test_folds_balanced(spark):
    df = spark.range(0, 103).withColumn("label", (F.col("id") % 3 == 0).cast("int")).withColumnRenamed("id", "page_id")
    f = sample.stratified_kfold(df, 5)
    assert f.count() == 103 and f.select("page_id").distinct().count() == 103
    sizes = f.groupBy("label", "fold").count().collect()
    for lab in (0, 1):
        c = [r["count"] for r in sizes if r.label == lab]
        assert max(c) - min(c) <= 1


def test_exact_rank_matches_sort(spark):
    df = spark.range(0, 500).withColumn("g", F.col("id") % 3).withColumn("k", (F.col("id") * 7919) % 1000)
    r = sample.exact_rank(df, "k", ["g"]).collect()
    for g in range(3):
        rows = sorted((x.k, x._rank) for x in r if x.g == g)
        assert [x[1] for x in rows] == list(range(1, len(rows) + 1))


def test_keep_first(spark):
    df = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("v", 3, "c")], "url string, page_id int, html string")
    r = {x.url: x.html for x in clean.keep_first(df, "url", "page_id").collect()}
    assert r == {"u": "a", "v": "c"}


def test_ks_identical_is_zero(spark):
    from pagelab.operators import drift
    df = spark.createDataFrame([(e, "f", float(v)) for e in ("old", "new") for v in (1, 2, 2, 3)],
                               "era string, feature string, value double")
    assert drift.ks_drift(df, "era", "old", "new").first().ks == 0.0


def test_registries():
    from pagelab.operators import models
    assert models.create_model("structural_rf") is not None
    with pytest.raises(ValueError):
        models.create_model("no_such_model")
    assert models.merge_settings({"epochs": 3}, {"epochs": 9, "batch_size": 32}) == {"epochs": 3, "batch_size": 32}


def test_char_wb_ngrams(spark):
    g = one(spark, t="ab").select(T.char_wb_ngrams("t").alias("g")).first().g
    # padded " ab ": 1-grams x4, 2-grams x3, 3-grams x2, 4-gram x1
    assert len(g) == 10 and " ab " in g


def test_word_ngrams(spark):
    g = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>").select(T.word_ngrams("t", 2, 3).alias("g")).first().g
    assert g == ["a b", "b c", "a b c"]


def test_processor_registry(spark):
    from pagelab.operators.processors import get_processor
    with pytest.raises(ValueError):
        get_processor("no_such_processor")
    df = spark.createDataFrame([(1, "http://example.com", "<html>1</html>"), (2, "https://phish-site.net/login", "<html>2</html>")],
                               "page_id long, url string, html string")
    m = get_processor("manual").fit(df).transform(df).collect()
    assert [len(r.features) for r in m] == [48, 48]
    mm = get_processor("multimodal", {"html_vocab_size": 100}).fit(df).transform(df).collect()
    assert all(len(r.url_ids) == 180 and len(r.html_ids) == 2000 for r in mm)
