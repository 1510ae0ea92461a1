"""Registered queries A (datasets), B (URL features), C (HTML patterns)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelab.functions import html as H, url as U
from pagelab.operators import clean, features, labels, sample
from pagelab.plans import catalog
from pagelab.plans import sqlfrag as S
from pagelab.plans.registry import D, I, register, select_list
from pagelab.sources import feeds, pages as P

# ------------------------------------------------------------------ SQL bases
PAGES_L = """pages_l AS (SELECT page_id, url, html,
  CAST(regexp_extract(coalesce(html, ''), '<html[^>]*\\slang="([^"]*)"', 1) <> 'en' AS INTEGER) AS label,
  CASE WHEN page_id % 2 = 0 THEN 'old' ELSE 'new' END AS era,
  CASE page_id % 6 WHEN 0 THEN 'spam' WHEN 1 THEN 'ham' WHEN 2 THEN 'Phishing'
       WHEN 3 THEN 'benign' WHEN 4 THEN 'malware' END AS category
  FROM pages)"""

CAT = ("CASE page_id % 6 WHEN 0 THEN 'spam' WHEN 1 THEN 'ham' WHEN 2 THEN 'Phishing' "
       "WHEN 3 THEN 'benign' WHEN 4 THEN 'malware' END")
DIRTY = f"""dirty AS (
  SELECT page_id, url, html, {CAT} AS category FROM pages
  UNION ALL SELECT page_id + 1000000000, url, html, {CAT} FROM pages WHERE ends_with(url, '/')
  UNION ALL SELECT page_id + 2000000000, url || '?v=null', NULL, {CAT} FROM pages WHERE contains(url, '#top')
  UNION ALL SELECT page_id + 3000000000, url || '&err=1',
     '<html><body><h1>404 Not Found</h1>' || repeat('.', 300) || '</body></html>', {CAT}
     FROM pages WHERE contains(url, 'utm_source=feed')
  UNION ALL SELECT page_id + 4000000000, url || '?short', substr(html, 1, 120), {CAT}
     FROM pages WHERE ends_with(url, '.html'))"""


def _pages(spark, sf):
    return catalog.pages(spark, sf)


# ======================================================================= A
@register("scan_pages", sql="SELECT page_id, url, html, CAST(NULL AS VARCHAR) AS category FROM pages")
def q_scan_pages(spark, sf):
    """A1: page table with normalised column names."""
    return P.scan_pages(spark, f"{sf}/pages.parquet")


@register("align_url_html", sql="""
SELECT u.page_id, u.url, h.html FROM (SELECT page_id, url FROM pages) u
JOIN (SELECT page_id, html FROM pages) h ON u.page_id = h.page_id""")
def q_align(spark, sf):
    """A2: URL rows and HTML rows aligned by key."""
    p = P.table(spark, sf, "pages")
    return P.align_url_html(p.select("page_id", "url"), p.select("page_id", "html"))


_URL_SQL = select_list({k: (v, "i") for k, v in S.structural_url().items()})


@register("inner_join_on_column", sql=f"""
WITH a AS (SELECT page_id, {S.n_match('html', '<[^>]+>')} AS html_num_tags, length(html) AS html_length FROM pages),
b AS (SELECT page_id, length(url) AS url_length, {S.cnt('url', '/')} AS url_slashes FROM pages)
SELECT a.page_id, {I('html_num_tags')} AS html_num_tags, {I('html_length')} AS html_length,
  {I('url_length')} AS url_length, {I('url_slashes')} AS url_slashes FROM a JOIN b ON a.page_id = b.page_id""")
def q_inner_join(spark, sf):
    """A3: HTML feature table joined with URL feature table on page_id."""
    p = P.table(spark, sf, "pages")
    a = p.select("page_id", F.regexp_count("html", F.lit(H.TAG_RE)).alias("html_num_tags"),
                 F.length("html").alias("html_length"))
    b = p.select("page_id", F.length("url").alias("url_length"), U.count_char("url", "/").alias("url_slashes"))
    return P.inner_join_on_column(a, b, "page_id")


@register("union_tag_era", sql=f"""WITH {PAGES_L}
SELECT page_id, url, 'dataset_old' AS dataset FROM pages_l WHERE era = 'old'
UNION ALL SELECT page_id, url, 'dataset_new' FROM pages_l WHERE era = 'new'""")
def q_union(spark, sf):
    """A4: concatenation of two eras with a literal dataset column."""
    p = _pages(spark, sf).select("page_id", "url", "era")
    return P.union_tag_era({"dataset_old": p.where("era = 'old'").drop("era"),
                            "dataset_new": p.where("era = 'new'").drop("era")}, "dataset")


@register("map_label", sql=f"""WITH {PAGES_L}
SELECT page_id, category,
  CASE category WHEN 'ham' THEN 0 WHEN 'spam' THEN 1 WHEN 'benign' THEN 0 WHEN 'phishing' THEN 1 END::BIGINT AS label_pipeline,
  (CASE WHEN lower(category) IN ('phishing', 'malware', 'spam') THEN 1 ELSE 0 END)::BIGINT AS label_standardise,
  (CASE WHEN contains(trim(lower(category)), 'spam') THEN 1 WHEN contains(trim(lower(category)), 'ham') THEN 0 END)::BIGINT AS label_contains,
  (CASE WHEN lower(category) IN ('phishing', 'malware', 'spam') THEN 1 ELSE 0 END)::BIGINT AS label_isin
FROM pages_l""")
def q_map_label(spark, sf):
    """A5: the four label policies side by side (contains keeps NULLs here;
    ``map_label(policy='contains')`` drops them)."""
    p = _pages(spark, sf).select("page_id", "category")
    p = labels.map_label(p, "pipeline", out="label_pipeline")
    return p.select("page_id", "category", "label_pipeline",
                    labels.label_standardise("category").alias("label_standardise"),
                    labels.label_contains("category").alias("label_contains"),
                    labels.label_isin("category").alias("label_isin"))


@register("map_label_contains_dropped", sql=f"""WITH {PAGES_L}
SELECT page_id, label FROM (SELECT page_id,
  (CASE WHEN contains(trim(lower(category)), 'spam') THEN 1 WHEN contains(trim(lower(category)), 'ham') THEN 0 END)::BIGINT AS label
  FROM pages_l) WHERE label IS NOT NULL""")
def q_map_label_contains(spark, sf):
    """A5 (contains policy): unmatched categories are dropped."""
    return labels.map_label(_pages(spark, sf).select("page_id", "category"), "contains").select("page_id", "label")


@register("standardize_schema", sql=f"""WITH {PAGES_L}
SELECT url AS Data, html, (CASE WHEN lower(category) IN ('phishing', 'malware', 'spam') THEN 1 ELSE 0 END)::BIGINT AS Category
FROM pages_l""")
def q_standardize(spark, sf):
    """Unify to Data, html, Category:int (standardise policy)."""
    p = _pages(spark, sf)
    return p.select(F.col("url").alias("Data"), "html", labels.label_standardise("category").alias("Category"))


_HOSTS_SQL = f"""hosts AS (SELECT row_number() OVER (ORDER BY domain) AS rank, domain
  FROM (SELECT DISTINCT {S.netloc(S.with_http('url'))} AS domain FROM pages))"""


def _ranked_hosts(spark, sf):
    """Rank list: distinct hosts numbered in domain order (distributed sort)."""
    p = P.table(spark, sf, "pages")
    hosts = p.select(H.page_domain("url").alias("domain")).distinct()
    return sample.global_rank(hosts, ["domain"], out="rank").select("rank", "domain")


@register("feed_rank_list", sql=f"""WITH {_HOSTS_SQL}
SELECT rank, domain, 'https://' || domain AS url FROM hosts""")
def q_feed_rank_list(spark, sf):
    """Ranked domain list -> https URLs in rank order."""
    return feeds.feed_rank_list(_ranked_hosts(spark, sf))


@register("anti_join_existing", sql=f"""WITH {_HOSTS_SQL},
cand AS (SELECT rank, domain, 'https://' || domain AS url FROM hosts),
known AS (SELECT DISTINCT 'https://' || {S.netloc('url')} AS url FROM pages WHERE starts_with(url, 'https://'))
SELECT c.url, c.rank, c.domain FROM cand c WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.url = c.url)""")
def q_anti_join(spark, sf):
    """Candidate URLs from the rank list minus hosts already crawled over https."""
    cand = feeds.feed_rank_list(_ranked_hosts(spark, sf))
    p = P.table(spark, sf, "pages").where(F.col("url").startswith("https://"))
    known = p.select(F.concat(F.lit("https://"), U.netloc("url")).alias("url"))
    return feeds.anti_join_existing(cand, known, "url", "rank")


_FEED_JSON = """'{"url": "http://' || event_type || '.feed.example/' || user_id || '/' ||
  CAST(json_extract(props, '$.k') AS INTEGER) || '", "online": "' ||
  (CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'yes' ELSE 'no' END) ||
  '", "verified": "' || (CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'yes' ELSE 'no' END) || '"}'"""


def _json_feed(spark, sf):
    e = P.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    doc = F.to_json(F.struct(
        F.concat(F.lit("http://"), F.col("event_type"), F.lit(".feed.example/"), F.col("user_id").cast("string"),
                 F.lit("/"), k.cast("string")).alias("url"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), "yes").otherwise("no").alias("online"),
        F.when(F.col("event_type").isin("click", "purchase", "signup"), "yes").otherwise("no").alias("verified")))
    return feeds.parse_json_feed(e.select("event_id", doc.alias("value")))


@register("feed_json_verified", sql=f"""
SELECT event_id, json_extract_string(j, '$.url') AS url FROM (SELECT event_id, {_FEED_JSON} AS j FROM events)
WHERE json_extract_string(j, '$.online') = 'yes' AND json_extract_string(j, '$.verified') = 'yes'""")
def q_feed_json(spark, sf):
    """JSON threat feed (one document per event) -> online and verified URLs."""
    return feeds.feed_json_verified(_json_feed(spark, sf)).select("event_id", "url")


_LINES_SQL = """lines AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, trim(l[i]) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), range(1, len(l) + 1) AS r(i)),
known AS (SELECT DISTINCT trim(b[i]) AS line FROM (SELECT string_split(text, chr(10)) AS b FROM benchmark), range(1, len(b) + 1) AS r(i))"""


@register("feed_text_lines", sql=f"""WITH {_LINES_SQL}
SELECT doc_id, line_no, line FROM lines WHERE line <> '' AND line NOT IN (SELECT line FROM known)""")
def q_feed_text(spark, sf):
    """A10: a text feed (document lines) trimmed, non-empty, minus known lines."""
    docs = P.table(spark, sf, "documents")
    bench = feeds.text_lines_of(P.table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id"))
    lines = feeds.text_lines_of(docs)
    return feeds.feed_text_lines(lines, bench).select("doc_id", "line_no", "line")


@register("feed_fallback", sql=f"""WITH {_LINES_SQL},
f1 AS (SELECT json_extract_string(j, '$.url') AS url FROM (SELECT {_FEED_JSON} AS j FROM events)
       WHERE json_extract_string(j, '$.online') = 'yes' AND json_extract_string(j, '$.verified') = 'yes'),
f2 AS (SELECT line AS url FROM lines WHERE line <> ''),
t AS (SELECT 0 AS prio, url FROM f1 UNION ALL SELECT 1, url FROM f2)
SELECT url FROM t WHERE prio = (SELECT min(prio) FROM t)""")
def q_feed_fallback(spark, sf):
    """The verified JSON feed if it yields anything, else the text feed."""
    f1 = feeds.feed_json_verified(_json_feed(spark, sf)).select("url")
    f2 = feeds.text_lines_of(P.table(spark, sf, "documents")).where(F.trim("line") != "") \
        .select(F.trim("line").alias("url"))
    return feeds.feed_fallback(f1, f2)


def dirty_pages(spark, sf):
    """Pages plus derived dirty copies (duplicate URLs, NULL HTML, error
    pages, truncated pages) for the cleaning operators. One scan: every page
    emits its variants from an in-row array that is exploded."""
    p = P.table(spark, sf, "pages")
    cat = catalog.category_of("page_id")
    pid, url, html = F.col("page_id"), F.col("url"), F.col("html")
    err_html = F.concat(F.lit("<html><body><h1>404 Not Found</h1>"), F.repeat(F.lit("."), 300), F.lit("</body></html>"))

    def variant(keep, off, u, h):
        return F.struct(keep.alias("keep"), (pid + off).alias("page_id"), u.alias("url"), h.cast("string").alias("html"))
    variants = F.array(
        variant(F.lit(True), 0, url, html),
        variant(url.endswith("/"), 1000000000, url, html),
        variant(url.contains("#top"), 2000000000, F.concat(url, F.lit("?v=null")), F.lit(None)),
        variant(url.contains("utm_source=feed"), 3000000000, F.concat(url, F.lit("&err=1")), err_html),
        variant(url.endswith(".html"), 4000000000, F.concat(url, F.lit("?short")), F.substring(html, 1, 120)))
    v = p.select(cat.alias("category"), F.explode(F.filter(variants, lambda x: x["keep"])).alias("v"))
    return v.select("v.page_id", "v.url", "v.html", "category")


@register("page_validity_filter", sql=f"""WITH {DIRTY}
SELECT page_id, url, regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g') AS html
FROM dirty WHERE length({S.strip_ws('html')}) > 100""")
def q_validity(spark, sf):
    """Pages with more than 100 non-blank characters, control chars removed."""
    return clean.page_validity_filter(dirty_pages(spark, sf)).select("page_id", "url", "html")


@register("append_dedup", sql=f"""WITH {PAGES_L},
u AS (SELECT 0 AS prio, page_id, url, html, 'old' AS source FROM pages_l WHERE era = 'old'
      UNION ALL SELECT 1, page_id + 1000000000, url, html || ' ', 'new' FROM pages_l)
SELECT url, page_id, source, length(html)::BIGINT AS html_length FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY prio, page_id) AS rn FROM u) WHERE rn = 1""")
def q_append_dedup(spark, sf):
    """Old crawl + full re-crawl, one row per URL, old rows win."""
    p = _pages(spark, sf)
    n = F.length("html").alias("html_length")  # measured in the scan: texts are not shuffled for a length
    old = p.where("era = 'old'").select("page_id", "url", n, F.lit("old").alias("source"))
    new = p.select((F.col("page_id") + 1000000000).alias("page_id"), "url",
                   (F.length("html") + 1).alias("html_length"), F.lit("new").alias("source"))
    return clean.append_dedup(old, new).select("url", "page_id", "source", "html_length")


_CLEAN_SQL = f"""{DIRTY},
nn AS (SELECT * FROM dirty WHERE page_id IS NOT NULL AND url IS NOT NULL AND html IS NOT NULL AND category IS NOT NULL),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM nn) WHERE rn = 1)"""


@register("clean_pages", sql=f"""WITH {_CLEAN_SQL}
SELECT page_id, url, category, length(html)::BIGINT AS html_length FROM firsts
WHERE length(html) > 150 AND NOT {S.error_page('html')}""")
def q_clean(spark, sf):
    """NULLs, duplicate URLs, short pages and error pages removed."""
    d = dirty_pages(spark, sf)
    return (d.select("page_id", "category").join(clean.clean_keys(d), "page_id")
            .select("page_id", "url", "category", "html_length"))


@register("clean_funnel", sql=f"""WITH {_CLEAN_SQL},
c AS (SELECT (SELECT count(*) FROM dirty) AS n, (SELECT count(*) FROM nn) AS nonnull,
  (SELECT count(*) FROM firsts) AS dedup,
  (SELECT count(*) FROM firsts WHERE length(html) > 150) AS short,
  (SELECT count(*) FROM firsts WHERE length(html) > 150 AND NOT {S.error_page('html')}) AS errors)
SELECT step_no::BIGINT AS step_no, step, rows::BIGINT AS rows, (n - rows)::BIGINT AS removed FROM (
  SELECT 0 AS step_no, 'initial' AS step, n AS rows, n FROM c UNION ALL
  SELECT 1, 'drop_nulls', nonnull, n FROM c UNION ALL SELECT 2, 'dedup_url', dedup, n FROM c UNION ALL
  SELECT 3, 'drop_short_html', short, n FROM c UNION ALL SELECT 4, 'drop_error_pages', errors, n FROM c)""")
def q_funnel(spark, sf):
    """Rows after each cleaning step."""
    return clean.clean_funnel(dirty_pages(spark, sf))


@register("verify_dataset", sql=f"""WITH {DIRTY}
SELECT count(*) AS rows, count(*) FILTER (WHERE url IS NULL) AS null_url,
  count(*) FILTER (WHERE html IS NULL) AS null_html, count(*) FILTER (WHERE category IS NULL) AS null_category,
  count(*) FILTER (WHERE {S.strip_ws('url')} = '') AS empty_url,
  count(*) FILTER (WHERE {S.strip_ws('html')} = '') AS empty_html,
  (count(*) - count(DISTINCT url)) AS duplicate_urls FROM dirty""")
def q_verify(spark, sf):
    """Verification counts of the dirty page table."""
    return clean.verify_dataset(dirty_pages(spark, sf))


@register("class_distribution", sql=f"""WITH {DIRTY}
SELECT category, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
FROM dirty GROUP BY category""")
def q_class_dist(spark, sf):
    """Count and percentage per category."""
    return clean.class_distribution(dirty_pages(spark, sf))


def _u(seed: int) -> str:
    """The sampling hash of a page: hex digits in the order of the numbers they write."""
    return f"substr(md5(CAST(page_id AS VARCHAR) || ':{seed}'), 1, 13)"


@register("sample_n", sql=f"""WITH {PAGES_L}
SELECT page_id, url, label::BIGINT AS label FROM pages_l ORDER BY {_u(42)}, page_id LIMIT 100""")
def q_sample_n(spark, sf):
    """100 seeded rows."""
    return sample.sample_n(_pages(spark, sf).select("page_id", "url", "label"), 100)


_RANKED = f"row_number() OVER (PARTITION BY label ORDER BY {_u(42)}, page_id) AS rk, count(*) OVER (PARTITION BY label) AS n_class"


@register("balanced_sample", sql=f"""WITH {PAGES_L}
SELECT page_id, url, label::BIGINT AS label FROM (SELECT *, {_RANKED} FROM pages_l) WHERE rk <= 40""")
def q_balanced(spark, sf):
    """40 seeded rows per surrogate class."""
    return sample.balanced_sample(_pages(spark, sf).select("page_id", "url", "label"), 40)


@register("head_per_class", sql=f"""WITH {PAGES_L}
SELECT page_id, url, label FROM pages_l WHERE label = 1 ORDER BY page_id LIMIT 30""")
def q_head(spark, sf):
    """First 30 positive rows."""
    return sample.head_per_class(_pages(spark, sf).select("page_id", "url", "label"), 1, 30)


@register("stratified_split", sql=f"""WITH {PAGES_L}
SELECT page_id, label::BIGINT AS label, CASE WHEN rk <= round(n_class * 0.2) THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, {_RANKED} FROM pages_l)""")
def q_split(spark, sf):
    """Per-class 80/20 split."""
    return sample.stratified_split(_pages(spark, sf).select("page_id", "label"), 0.2)


@register("stratified_kfold", sql=f"""WITH {PAGES_L}
SELECT page_id, label::BIGINT AS label, (rk - 1) % 5 AS fold FROM (SELECT *, {_RANKED} FROM pages_l)""")
def q_kfold(spark, sf):
    """5 class-balanced folds."""
    return sample.stratified_kfold(_pages(spark, sf).select("page_id", "label"), 5)


@register("ordered_split", sql="""
SELECT page_id, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT page_id, row_number() OVER (ORDER BY page_id) AS rn, count(*) OVER () AS n FROM pages)""")
def q_ordered_split(spark, sf):
    """First 80 % by page order train, rest test."""
    return sample.ordered_split(P.table(spark, sf, "pages").select("page_id"), 0.8)


@register("rolling_mix", sql=f"""WITH {PAGES_L}
(SELECT page_id, label, 'old' AS source FROM pages_l WHERE era = 'old' ORDER BY page_id LIMIT 40)
UNION ALL (SELECT page_id, label, 'new' FROM pages_l WHERE era = 'new' ORDER BY page_id LIMIT 10)""")
def q_rolling(spark, sf):
    """Training window = 40 old + 10 new rows (80/20)."""
    p = _pages(spark, sf).select("page_id", "label", "era")
    return sample.rolling_mix(p.where("era='old'").drop("era"), p.where("era='new'").drop("era"), 40, 10)


#: Old and new rows that a mixed retraining set draws.
MIXED = (3_000, 50)


@register("mixed_retrain_set", sql=f"""WITH {PAGES_L},
r AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY {_u(42)}, page_id) AS rk FROM pages_l)
SELECT page_id, label::BIGINT AS label, CASE WHEN era = 'new' AND rk > {MIXED[1]} THEN 'test' ELSE 'train' END AS split
FROM r WHERE era = 'new' OR rk <= {MIXED[0]}""")
def q_mixed(spark, sf):
    """3,000 old + 50 new rows for training, remaining new rows for test."""
    p = _pages(spark, sf).select("page_id", "label", "era")
    return sample.mixed_retrain_set(p.where("era='old'").drop("era"), p.where("era='new'").drop("era"), *MIXED)


_BASE_SQL_URL = {k: (v, "d") for k, v in S.structural_url().items()}


@register("blind_features", sql=f"""
SELECT page_id, {select_list({**{k: ('0.0', 'd') for k in list(_BASE_SQL_URL)[:6]},
                               **{k: v for k, v in list(_BASE_SQL_URL.items())[6:]}})},
  {D(S.pattern_html()['html_length'])} AS html_length FROM pages""")
def q_blind(spark, sf):
    """Six URL columns zeroed before training."""
    p = P.table(spark, sf, "pages")
    f = p.select("page_id", *[c.cast("double").alias(n) for n, c in U.structural_url_features("url").items()],
                 F.length("html").cast("double").alias("html_length"))
    return sample.blind_features(f, list(U.structural_url_features("url"))[:6])


# ======================================================================= B
@register("url_structural_features", sql=f"SELECT page_id, {select_list(_BASE_SQL_URL)} FROM pages")
def q_url_struct(spark, sf):
    """The ten URL columns of the structural vector."""
    f = features.url_features(P.table(spark, sf, "pages"), which="structural")
    return f.select("page_id", *[F.col(c).cast("double") for c in f.columns[1:]])


_LEX_KINDS = {"url_digit_ratio": "d", "domain_entropy": "d"}


@register("url_lexical_features", sql=f"""SELECT page_id, {select_list({k: (v, _LEX_KINDS.get(k, 'i'))
                                                                       for k, v in S.lexical_url().items()})} FROM pages""")
def q_url_lex(spark, sf):
    """The eleven lexical URL columns."""
    return features.url_features(P.table(spark, sf, "pages"), which="lexical")


@register("url_manual_features", sql=f"""SELECT page_id, {select_list({k: (v, 'i') for k, v in S.manual_url().items()})}
FROM pages""")
def q_url_manual(spark, sf):
    """The sixteen hand-written URL columns."""
    return features.url_features(P.table(spark, sf, "pages"), which="manual")


@register("manual_vector_48", sql=f"""SELECT page_id,
  list_concat([{', '.join(f'CAST({v} AS DOUBLE)' for v in S.manual_url().values())}], list_transform(range(32), lambda x: 0.0)) AS features
FROM pages""")
def q_manual_vec(spark, sf):
    """Manual features zero-padded to 48."""
    p = P.table(spark, sf, "pages")
    return p.select("page_id", U.manual_vector("url", 48).alias("features"))


def _lex_table(spark, sf):
    return features.url_features(P.table(spark, sf, "pages"), which="lexical")


@register("url_vector_11", sql=f"""WITH f AS (SELECT page_id, {select_list({k: (v, 'x') for k, v in S.lexical_url().items()})} FROM pages)
SELECT page_id, {', '.join(f"round((({k}) - avg({k}) OVER ()) / (CASE WHEN stddev_pop({k}) OVER () = 0 THEN 1 ELSE stddev_pop({k}) OVER () END), 6) AS z_{k}" for k in S.lexical_url())}
FROM f""")
def q_url_vec(spark, sf):
    """The eleven lexical columns z-scored (population sigma)."""
    from pagelab.operators.scale import zscore_fit, zscore_apply
    f = _lex_table(spark, sf)
    cols = f.columns[1:]
    st = zscore_fit(f, cols)
    return zscore_apply(f, st, cols, prefix="z_").select("page_id", *[f"z_{c}" for c in cols])


@register("eda_url_features", sql=f"""SELECT page_id, {select_list({k: (v, 'd' if 'ratio' in k else 'i') for k, v in S.eda_url().items()})} FROM pages""")
def q_eda_url(spark, sf):
    """Exploratory URL table."""
    return features.url_features(P.table(spark, sf, "pages"), which="eda")


@register("https_share", sql=f"""WITH {PAGES_L}
SELECT era, label, round(avg(CASE WHEN starts_with(url, 'https') THEN 1.0 ELSE 0.0 END), 6) AS https_share,
  count(*) AS pages FROM pages_l GROUP BY era, label""")
def q_https(spark, sf):
    """Share of https URLs per era and class."""
    p = _pages(spark, sf)
    return p.groupBy("era", "label").agg(F.avg(F.col("url").startswith("https").cast("double")).alias("https_share"),
                                         F.count(F.lit(1)).alias("pages"))


# ======================================================================= C
_PAT = S.pattern_html()
_PAT_SQL = {k: (v, "d") for k, v in _PAT.items()}


@register("html_pattern_features", sql=f"SELECT page_id, {select_list(_PAT_SQL)} FROM pages")
def q_html_pat(spark, sf):
    """Pattern-based HTML columns of the structural vector."""
    p = P.table(spark, sf, "pages")
    return p.select("page_id", *[c.cast("double").alias(n) for n, c in H.pattern_features("url", "html").items()])


@register("brand_discrepancy", sql=f"SELECT page_id, {D(S.brand_lev())} AS brand_discrepancy FROM pages")
def q_brand(spark, sf):
    """C11 (SQL form): normalised edit distance of cleaned title and domain."""
    p = P.table(spark, sf, "pages")
    return p.select("page_id", H.brand_discrepancy_lev("html", H.page_domain("url")).alias("brand_discrepancy"))


_BRAND_RATIO = f"WITH RECURSIVE {S.brand_ratio_ctes()} SELECT page_id, {D('bd')} AS brand_discrepancy FROM sm_brand"


@register("brand_discrepancy_ratio", sql=_BRAND_RATIO)
def q_brand_ratio(spark, sf):
    """C11 by definition: sequence-matcher ratio as a column expression, no Python workers."""
    from pagelab.functions.sequence import brand_discrepancy
    p = P.table(spark, sf, "pages")
    return p.select("page_id", brand_discrepancy(H.brand_title_norm("html"),
                                                 H.brand_domain_norm(H.page_domain("url"))).alias("brand_discrepancy"))


@register("brand_discrepancy_seqmatch", sql=_BRAND_RATIO)
def q_brand_sm(spark, sf):
    """C11: sequence-matcher form (vectorised pandas UDF)."""
    from pagelab.functions.udfs import brand_discrepancy_difflib
    p = P.table(spark, sf, "pages")
    return p.select("page_id", brand_discrepancy_difflib(H.brand_title_norm("html"),
                                                         H.brand_domain_norm(H.page_domain("url"))).alias("brand_discrepancy"))


@register("empty_link_ratio_modes", sql=f"""SELECT page_id,
  {D(_PAT['html_empty_link_ratio'])} AS empty_link_compat,
  {D(S.n_match('lower(html)', H.EMPTY_HREF_INTENT_RE) + " / greatest(len(regexp_extract_all(lower(html), " + S.q(S.HREF) + ", 1)), 1)")} AS empty_link_intent
FROM pages""")
def q_empty_modes(spark, sf):
    """Dead-link ratio in the reference-compatible and the intended form."""
    p = P.table(spark, sf, "pages")
    hl = F.lower("html")
    return p.select("page_id", H.empty_link_ratio(hl, "compat").alias("empty_link_compat"),
                    H.empty_link_ratio(hl, "intent").alias("empty_link_intent"))


@register("visible_text", sql=f"""SELECT page_id, substr({S.strip_ws(
    "regexp_replace(regexp_replace(" + S.no_refs(S.letters("regexp_replace(regexp_replace(lower(html), '(?s)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')")) + ", '[^a-zA-Z\\t\\n\\x0B\\f\\r ]', '', 'g'), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')")}, 1, 2000) AS visible_text
FROM pages""")
def q_visible(spark, sf):
    """Cleaned visible text, first 2000 characters."""
    p = P.table(spark, sf, "pages")
    return p.select("page_id", H.visible_text("html").alias("visible_text"))


@register("title_link_list_text", sql=f"SELECT page_id, {S.title_link_list()} AS text FROM pages")
def q_tll(spark, sf):
    """URL parts + stripped title, anchor and list text."""
    p = P.table(spark, sf, "pages")
    return p.select("page_id", H.title_link_list_text("url", "html").alias("text"))
