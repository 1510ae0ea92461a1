"""Registered queries E (text vectors and token sequences)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelab.functions import dom as DF, html as H
from pagelab.operators import dom, heavy as HV, text as T
from pagelab.plans import catalog
from pagelab.plans import sqlfrag as S
from pagelab.plans.q_pages import PAGES_L
from pagelab.plans.registry import register
from pagelab.sources import pages as P

TAGS = "regexp_extract_all(lower(coalesce(html, '')), '<([a-zA-Z0-9]+)[^>]*>', 1)"
EV = f"evs AS ({S.events_cte('pages')})"
XP = (f"list_transform(list_filter({S.xpaths('ev')}, lambda p: contains(p, '/')), "
      f"lambda p: '<' || substr(p, strpos(p, '/') + 1) || '>')")
WORDS = ("list_transform(regexp_extract_all(regexp_replace(regexp_replace(coalesce(html, ''), "
         "'(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->', ' ', 'g'), "
         "'<[^>]+>|&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g'), '[a-zA-Z]{3,}'), lambda w: lower(w))")


def ngrams_sql(t: str, lo: int, hi: int) -> str:
    parts = [f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n} - 1], ' '))"
             for n in range(lo, hi + 1)]
    return f"flatten([{', '.join(parts)}])"


def tfidf_sql(docs_cte: str, k: int, groups: str = "", out: str = "weights") -> str:
    """docs(g.., page_id, g) -> vocabulary or long weights, per group."""
    gsel = f"{groups}, " if groups else ""
    gby = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    using = f"USING ({groups})" if groups else "ON TRUE"
    base = f"""WITH {docs_cte},
tf AS (SELECT {gsel}page_id, term, count(*) AS tf FROM (SELECT {gsel}page_id, unnest(g) AS term FROM docs) GROUP BY {gby}page_id, term),
st AS (SELECT {gsel}term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY {gby}term),
top AS (SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY total DESC, term) AS r FROM st) WHERE r <= {k}),
nd AS (SELECT {gsel}count(*) AS n FROM docs {'GROUP BY ' + groups if groups else ''}),
voc AS (SELECT {gsel}term, row_number() OVER ({part}ORDER BY term) - 1 AS idx, df, total,
        ln((1 + n) / (1 + df)) + 1 AS idf FROM top JOIN nd {using})"""
    if out == "vocab":
        return base + f"""
SELECT {gsel}term, idx::BIGINT AS idx, df::BIGINT AS df, total::BIGINT AS total, round(idf, 6) AS idf FROM voc"""
    return base + f""",
w AS (SELECT {'tf.' + groups + ', ' if groups else ''}tf.page_id, tf.term, voc.idx, tf.tf * voc.idf AS w FROM tf JOIN voc USING ({gby}term))
SELECT {gsel}page_id, term, idx::BIGINT AS idx, {'round' if out == 'weights' else ''}(w / sqrt(sum(w * w) OVER (PARTITION BY {gby}page_id)){', 6' if out == 'weights' else ''}) AS weight FROM w"""


def _pages(spark, sf):
    return catalog.pages(spark, sf)


def _tag_grams(spark, sf):
    p = P.table(spark, sf, "pages")
    return p.select("page_id", T.word_ngrams(DF.tag_sequence("html"), 2, 3).alias("g"))


@register("ngrams", sql=f"SELECT page_id, {ngrams_sql(TAGS, 2, 3)} AS ngrams FROM pages")
def q_ngrams(spark, sf):
    """Tag 2- and 3-grams per page."""
    return _tag_grams(spark, sf).withColumnRenamed("g", "ngrams")


def _word_docs(spark, sf):
    return P.table(spark, sf, "pages").select("page_id", T.page_words("html").alias("g"))


@register("tfidf_fit", sql=tfidf_sql(f"docs AS (SELECT page_id, {WORDS} AS g FROM pages)", 100, out="vocab"))
def q_tfidf_fit(spark, sf):
    """100-term vocabulary of page words with smooth idf."""
    return T.tfidf_fit(_word_docs(spark, sf), "page_id", "g", 100)


@register("tfidf_fit_summaries", sql=tfidf_sql(f"docs AS (SELECT page_id, {WORDS} AS g FROM pages)", 100, out="vocab"))
def q_tfidf_fit_summaries(spark, sf):
    """E2 by frequent-items summaries and an exact recount: the vocabulary of ``tfidf_fit``."""
    return HV.tfidf_vocabulary(_word_docs(spark, sf), "g", 100)


@register("tfidf_transform", sql=tfidf_sql(f"docs AS (SELECT page_id, {WORDS} AS g FROM pages)", 100))
def q_tfidf_tr(spark, sf):
    """L2-normalised TF-IDF weights of page words (long form)."""
    _, w = T.tfidf_fit_transform(_word_docs(spark, sf), "page_id", "g", 100)
    return w.select("page_id", "term", "idx", "weight")


@register("tag_tfidf_50", sql=tfidf_sql(f"docs AS (SELECT page_id, {ngrams_sql(TAGS, 2, 3)} AS g FROM pages)", 50))
def q_tag_tfidf(spark, sf):
    """Tag-sequence 2/3-gram TF-IDF, 50 terms."""
    _, w = T.tfidf_fit_transform(_tag_grams(spark, sf), "page_id", "g", 50)
    return w.select("page_id", "term", "idx", "weight")


@register("xpath_tfidf_25", sql=tfidf_sql(f"{EV}, docs AS (SELECT page_id, {ngrams_sql(XP, 2, 3)} AS g FROM evs)", 25))
def q_xpath_tfidf(spark, sf):
    """E5: XPath-sequence 2/3-gram TF-IDF, 25 terms."""
    p = dom.with_paths(P.table(spark, sf, "pages").select("page_id", "html"))
    toks = F.expr(DF.xpath_below_root_sql("paths"))
    _, w = T.tfidf_fit_transform(p.select("page_id", T.word_ngrams(toks, 2, 3).alias("g")), "page_id", "g", 25)
    return w.select("page_id", "term", "idx", "weight")


_ZONES = f"""docs AS (SELECT zone, page_id, {ngrams_sql('z', 1, 2)} AS g FROM (
  SELECT page_id, 1 AS zone, list_slice(t, 1, c) AS z FROM (SELECT page_id, t, greatest(len(t) // 3, 1) AS c FROM (SELECT page_id, {TAGS} AS t FROM pages))
  UNION ALL SELECT page_id, 2, list_slice(t, c + 1, 2 * c) FROM (SELECT page_id, t, greatest(len(t) // 3, 1) AS c FROM (SELECT page_id, {TAGS} AS t FROM pages))
  UNION ALL SELECT page_id, 3, list_slice(t, 2 * c + 1, len(t)) FROM (SELECT page_id, t, greatest(len(t) // 3, 1) AS c FROM (SELECT page_id, {TAGS} AS t FROM pages))))"""


@register("zone_tfidf_60", sql=tfidf_sql(_ZONES, 20, groups="zone").replace(
    "SELECT zone, page_id, term", "SELECT zone::BIGINT AS zone, page_id, term"))
def q_zone_tfidf(spark, sf):
    """Three independent 20-term (1,2)-gram TF-IDF fits, one per zone, in one job."""
    p = P.table(spark, sf, "pages").select("page_id", DF.tag_sequence("html").alias("t"))
    z1, z2, z3 = DF.spatial_zones("t")
    zs = p.select("page_id", F.explode(F.array(
        F.struct(F.lit(1).alias("zone"), z1.alias("z")), F.struct(F.lit(2).alias("zone"), z2.alias("z")),
        F.struct(F.lit(3).alias("zone"), z3.alias("z")))).alias("s"))
    d = zs.select("s.zone", "page_id", T.word_ngrams(F.col("s.z"), 1, 2).alias("g"))
    _, w = T.tfidf_fit_transform(d, "page_id", "g", 20, groups=["zone"])
    return w.select("zone", "page_id", "term", "idx", "weight")


_tll_sql = S.title_link_list


@register("title_link_list_text_sql", sql=f"SELECT page_id, {_tll_sql()} AS text FROM pages")
def q_tll_sql(spark, sf):
    """URL parts + stripped title, anchor and list text (oracle-checked)."""
    p = P.table(spark, sf, "pages")
    return p.select("page_id", H.title_link_list_text("url", "html").alias("text"))


_CHARWB = f"""docs AS (SELECT page_id, flatten(list_transform(list_filter(string_split_regex(lower(txt), '\\s+'), lambda w: w <> ''),
  lambda w: flatten(list_transform(range(1, least(4, length(w) + 2) + 1),
     lambda n: list_transform(range(1, length(w) + 2 - n + 2), lambda i: substr(' ' || w || ' ', i, n)))))) AS g
  FROM (SELECT page_id, {_tll_sql()} AS txt FROM pages))"""


@register("char_wb_tfidf", sql=tfidf_sql(_CHARWB, 5000, out="vocab"))
def q_charwb(spark, sf):
    """Character 1-4-gram (word-bounded) vocabulary, 5000 terms, with idf."""
    p = P.table(spark, sf, "pages")
    d = p.select("page_id", T.char_wb_ngrams(H.title_link_list_text("url", "html")).alias("g"))
    return T.tfidf_fit(d, "page_id", "g", 5000)


@register("char_wb_tfidf_scaled", sql=f"""WITH w AS ({tfidf_sql(_CHARWB, 5000, out="exact")}),
n AS (SELECT count(*) AS n FROM pages),
s AS (SELECT idx, sum(weight) / any_value(n.n) AS mu,
        greatest(sum(weight * weight) / any_value(n.n) - (sum(weight) / any_value(n.n)) ** 2, 0) AS var FROM w, n GROUP BY idx),
t AS (SELECT idx, mu, CASE WHEN var > 1e-18 THEN sqrt(var) ELSE 1 END AS sd FROM s),
g AS (SELECT p.page_id, t.idx, (coalesce(w.weight, 0) - mu) / sd AS z FROM pages p CROSS JOIN t
      LEFT JOIN w ON w.page_id = p.page_id AND w.idx = t.idx)
SELECT page_id, count(*) AS dim, round(sum(z * z), 6) AS sq_norm FROM g GROUP BY page_id""")
def q_charwb_scaled(spark, sf):
    """char_wb TF-IDF z-scored by column (population sigma): width and squared length per page."""
    p = P.table(spark, sf, "pages")
    d = p.select("page_id", T.char_wb_ngrams(H.title_link_list_text("url", "html")).alias("g"))
    v = T.tfidf_fit(d, "page_id", "g", 5000)
    return T.tfidf_scaled_norms(T.tfidf_transform(d, "page_id", "g", v), d, v, "page_id")


HYB = "regexp_extract_all(lower(coalesce(html, '')), '[\\p{L}\\p{N}_'']+|[^\\p{L}\\p{N}_\\s]')"


@register("hybrid_tokens", sql=f"SELECT page_id, {HYB} AS tokens FROM pages")
def q_hybrid(spark, sf):
    """Word and punctuation tokens of the lower-cased page."""
    return P.table(spark, sf, "pages").select("page_id", T.hybrid_tokens("html").alias("tokens"))


_VOCAB_SQL = f"""v AS (SELECT term, (row_number() OVER (ORDER BY cnt DESC, term) + 1) AS id, cnt FROM (
  SELECT term, count(*) AS cnt FROM (SELECT unnest({HYB}) AS term FROM pages) GROUP BY term))"""


@register("html_vocab", sql=f"WITH {_VOCAB_SQL} SELECT term, id::BIGINT AS id, cnt::BIGINT AS cnt FROM v WHERE id < 50000")
def q_html_vocab(spark, sf):
    """HTML token vocabulary (size 50000: ids 2..49999)."""
    d = P.table(spark, sf, "pages").select(T.hybrid_tokens("html").alias("t"))
    return T.frequency_vocab(d, "t", 50000)


@register("html_vocab_summaries", sql=f"WITH {_VOCAB_SQL} SELECT term, id::BIGINT AS id, cnt::BIGINT AS cnt FROM v WHERE id < 1000")
def q_html_vocab_summaries(spark, sf):
    """E9 by frequent-items summaries and an exact recount (size 1000: ids 2..999)."""
    d = P.table(spark, sf, "pages").select(T.hybrid_tokens("html").alias("t"))
    return HV.id_vocabulary(d, "t", 1000)


@register("html_token_ids", sql=f"""WITH {_VOCAB_SQL},
x AS (SELECT page_id, i, t[i] AS term FROM (SELECT page_id, {HYB}[1:2000] AS t FROM pages), range(1, len(t) + 1) AS r(i)),
y AS (SELECT page_id, list(coalesce(v.id, 1) ORDER BY i) AS ids FROM x LEFT JOIN (SELECT * FROM v WHERE id < 50000) v USING (term) GROUP BY page_id)
SELECT p.page_id, list_concat(coalesce(y.ids, []::BIGINT[]), list_transform(range(2000 - len(coalesce(y.ids, []::BIGINT[]))), lambda x: 0::BIGINT)) AS ids
FROM pages p LEFT JOIN y USING (page_id)""")
def q_html_ids(spark, sf):
    """First 2000 HTML token ids per page, zero padded."""
    p = P.table(spark, sf, "pages").select("page_id", T.hybrid_tokens("html").alias("t"))
    v = T.frequency_vocab(p, "t", 50000)
    return T.ids_from_vocab(p, "page_id", "t", v, 2000)


@register("url_char_ids", sql="""SELECT page_id, list_concat(ids, list_transform(range(180 - len(ids)), lambda x: 0::BIGINT)) AS ids
FROM (SELECT page_id, list_transform(string_split(substr(url, 1, 180), ''),
  lambda c: CASE WHEN ascii(c) < 128 THEN ascii(c) + 2 ELSE 1 END::BIGINT) AS ids FROM pages)""")
def q_url_char_ids(spark, sf):
    """URL character ids (ASCII + 2, else 1), 180 wide."""
    return P.table(spark, sf, "pages").select("page_id", T.url_char_ids("url").alias("ids"))


_CV = """cv AS (SELECT term, row_number() OVER (ORDER BY cnt DESC, term) + 1 AS id FROM (
  SELECT c AS term, count(*) AS cnt FROM (SELECT unnest(string_split(lower(url), '')) AS c FROM pages) GROUP BY c))"""


@register("char_frequency_ids", sql=f"""WITH {_CV},
x AS (SELECT page_id, i, string_split(lower(url), '')[i] AS c FROM pages, range(1, length(url) + 1) AS r(i)),
y AS (SELECT page_id, list(CASE WHEN cv.id IS NULL OR cv.id >= 128 THEN 1 ELSE cv.id END ORDER BY i)[1:256] AS ids
      FROM x LEFT JOIN cv ON cv.term = x.c GROUP BY page_id)
SELECT page_id, list_concat(ids, list_transform(range(256 - len(ids)), lambda x: 0::BIGINT)) AS ids FROM y""")
def q_char_freq(spark, sf):
    """Frequency-ranked character ids of the lower-cased URL, 256 wide."""
    p = P.table(spark, sf, "pages")
    return T.char_frequency_ids(p, T.char_frequency_vocab(p))


_SUB = ("list_filter(string_split_regex(regexp_replace(lower(regexp_replace(url, '([./\\-_?=&])', ' \\1 ', 'g')), "
        "'[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]', '', 'g'), '\\s+'), lambda w: w <> '')")


@register("url_subword_ids", sql=f"""WITH v AS (SELECT term, row_number() OVER (ORDER BY cnt DESC, term) + 1 AS id FROM (
  SELECT term, count(*) AS cnt FROM (SELECT unnest({_SUB}) AS term FROM pages) GROUP BY term)),
x AS (SELECT page_id, i, t[i] AS term FROM (SELECT page_id, {_SUB}[1:200] AS t FROM pages), range(1, len(t) + 1) AS r(i)),
y AS (SELECT page_id, list(coalesce(v.id, 1) ORDER BY i) AS ids FROM x LEFT JOIN (SELECT * FROM v WHERE id < 100) v USING (term) GROUP BY page_id)
SELECT p.page_id, list_concat(coalesce(y.ids, []::BIGINT[]), list_transform(range(200 - len(coalesce(y.ids, []::BIGINT[]))), lambda x: 0::BIGINT)) AS ids
FROM pages p LEFT JOIN y USING (page_id)""")
def q_subword(spark, sf):
    """URL sub-word ids (vocabulary 100 incl. pad and unknown), 200 wide."""
    p = P.table(spark, sf, "pages").select("page_id", T.url_subword_tokens("url").alias("t"))
    v = T.frequency_vocab(p, "t", 100)
    return T.ids_from_vocab(p, "page_id", "t", v, 200)


_KW = (f"list_filter(string_split_regex(lower({S.netloc(S.with_http('url'))} || {S.path(S.with_http('url'))}), '[^a-zA-Z]'), "
       f"lambda w: length(w) > 3 AND w NOT IN ({S.qlist(T.URL_KEYWORD_STOP)}))")


@register("url_keyword_top", sql=f"""WITH {PAGES_L}
SELECT term, count::BIGINT AS count, rank::BIGINT AS rank FROM (
  SELECT term, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, term) AS rank
  FROM (SELECT unnest({_KW}) AS term FROM pages_l WHERE label = 1) GROUP BY term) WHERE rank <= 15""")
def q_url_kw(spark, sf):
    """Top 15 URL keywords of positive pages."""
    p = _pages(spark, sf).where("label = 1").select(T.url_keyword_tokens("url").alias("t"))
    return T.top_terms(p, "t", 15).select("term", "count", "rank")


def _wf_sql(src: str, stop=tuple(T.WORD_FREQ_STOP)) -> str:
    return f"""WITH {PAGES_L},
c AS (SELECT era, label, w AS word, count(*) AS count FROM (
  SELECT era, label, unnest(list_filter({src}, lambda x: x NOT IN ({S.qlist(stop)}))) AS w FROM pages_l)
  GROUP BY era, label, w),
r AS (SELECT *, row_number() OVER (PARTITION BY era, label ORDER BY count DESC, word) AS rank FROM c)
SELECT era, label::BIGINT AS label, word, count::BIGINT AS count, rank::BIGINT AS rank,
  round(count / max(count) OVER (PARTITION BY era, label), 6) AS weight FROM r WHERE rank <= 150"""


@register("word_frequencies_text", sql=_wf_sql(WORDS))
def q_wf_text(spark, sf):
    """Top 150 visible-text words per era and class, weight relative to the top word."""
    p = _pages(spark, sf).select("era", "label", T.page_words("html").alias("w"))
    return T.word_frequencies(p, "w", ["era", "label"])


@register("word_frequencies_url", sql=_wf_sql("list_transform(regexp_extract_all(coalesce(url, ''), '[a-zA-Z]{3,}'), lambda w: lower(w))"))
def q_wf_url(spark, sf):
    """Top 150 URL words per era and class."""
    p = _pages(spark, sf).select("era", "label", T.url_words("url").alias("w"))
    return T.word_frequencies(p, "w", ["era", "label"])


_CLOUD_STOP = (*T.ENGLISH_STOP, *T.WORD_FREQ_STOP)


@register("word_cloud_text", sql=_wf_sql(WORDS, _CLOUD_STOP))
def q_cloud_text(spark, sf):
    """As ``word_frequencies_text``, without general English words as well."""
    p = _pages(spark, sf).select("era", "label", T.page_words("html").alias("w"))
    return T.word_frequencies(p, "w", ["era", "label"], stop=_CLOUD_STOP)
