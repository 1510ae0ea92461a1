"""Registered queries D (DOM structure)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelab.functions import dom as DF
from pagelab.operators import dom, features
from pagelab.plans import catalog
from pagelab.plans import sqlfrag as S
from pagelab.plans.q_pages import PAGES_L
from pagelab.plans.registry import register, select_list
from pagelab.sources import pages as P

EV = f"evs AS ({S.events_cte('pages_l')})"
PATHS = f"pp AS (SELECT page_id, label, html, {S.xpaths('ev')} AS paths FROM evs)"
# the frequency tree is built by the plain parser: no implied end tags
PLAIN = f"pp AS (SELECT page_id, label, era, html, {S.xpaths('ev', 'plain')} AS paths FROM evs)"


def _pages(spark, sf):
    return catalog.pages(spark, sf)


@register("tag_events", sql=f"""WITH {PAGES_L}, {EV}
SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, ev[i].name AS tag,
  CASE WHEN ev[i].closing THEN 'close' WHEN ev[i].void THEN 'void' ELSE 'open' END AS kind
FROM evs, range(1, len(ev) + 1) AS r(i)""")
def q_tag_events(spark, sf):
    """The ordered tag-event table."""
    return dom.tag_events(P.table(spark, sf, "pages"))


_TREE = {k: (v, "d") for k, v in S.tree().items()}


@register("dom_tree_features", sql=f"""WITH {PAGES_L}, {EV}
SELECT page_id, {select_list(_TREE)} FROM evs""")
def q_tree(spark, sf):
    """Depth, diversity, resources, forms, script share, element counts."""
    t = features.tree_features(P.table(spark, sf, "pages").select("page_id", "url", "html"))
    return t.select("page_id", *[F.col(c).cast("double") for c in features.TREE_7])


_TAGS = "regexp_extract_all(lower(coalesce(html, '')), '<([a-zA-Z0-9]+)[^>]*>', 1)"


@register("tag_sequence", sql=f"""SELECT page_id, array_to_string({_TAGS}, ' ') AS tag_seq,
  CAST(len({_TAGS}) AS BIGINT) AS n_tags FROM pages""")
def q_tag_seq(spark, sf):
    """Opening-tag sequence per page."""
    return dom.tag_sequence(P.table(spark, sf, "pages"))


@register("spatial_zones", sql=f"""SELECT page_id, array_to_string(z1, ' ') AS zone1, array_to_string(z2, ' ') AS zone2,
  array_to_string(z3, ' ') AS zone3, CAST(len(z1) AS BIGINT) AS zone1_size, CAST(len(z2) AS BIGINT) AS zone2_size,
  CAST(len(z3) AS BIGINT) AS zone3_size FROM (
  SELECT page_id, list_slice(t, 1, c) AS z1, list_slice(t, c + 1, 2 * c) AS z2, list_slice(t, 2 * c + 1, len(t)) AS z3
  FROM (SELECT page_id, t, greatest(len(t) // 3, 1) AS c FROM (SELECT page_id, {_TAGS} AS t FROM pages)))""")
def q_zones(spark, sf):
    """Three spatial zones of the tag sequence."""
    return dom.spatial_zones(P.table(spark, sf, "pages"))


_BELOW = "list_transform(list_filter(paths, lambda p: contains(p, '/')), lambda p: '<' || substr(p, strpos(p, '/') + 1) || '>')"


@register("xpath_sequence", sql=f"""WITH {PAGES_L}, {EV}, {PATHS}
SELECT page_id, array_to_string({_BELOW}, ' ') AS xpath_seq, CAST(len({_BELOW}) AS BIGINT) AS n_paths FROM pp""")
def q_xpath_seq(spark, sf):
    """XPath sequence per page."""
    return dom.xpath_sequence(P.table(spark, sf, "pages"))


def _freq_sql(depth, mf):
    return f"""WITH {PAGES_L}, {EV}, {PLAIN},
d AS (SELECT label, list_filter(list_distinct(list_transform(paths, lambda x: '[document]/' || x)),
        lambda x: len(string_split(x, '/')) - 1 <= {depth}) AS paths FROM pp WHERE html IS NOT NULL),
tot AS (SELECT label, count(*) AS docs FROM d GROUP BY label),
c AS (SELECT label, path, count(*) AS pages FROM (SELECT label, unnest(paths) AS path FROM d) GROUP BY label, path),
f AS (SELECT c.label, path, pages, pages / docs AS freq FROM c JOIN tot USING (label) WHERE pages / docs >= {mf})"""


@register("xpath_document_frequency", sql=_freq_sql(20, 0.01) +
          "\nSELECT label::BIGINT AS label, path, pages::BIGINT AS pages, round(freq, 6) AS freq FROM f")
def q_xfreq(spark, sf):
    """Per-class path document frequency (depth 20, min share 0.01)."""
    return dom.xpath_document_frequency(_pages(spark, sf), max_depth=20, min_freq=0.01)


@register("xpath_edges", sql=_freq_sql(20, 0.01) + """
SELECT c.label::BIGINT AS label, p.path AS parent, c.path AS child, round(c.freq, 6) AS weight
FROM f c JOIN f p ON c.label = p.label AND p.path = regexp_extract(c.path, '^(.*)/[^/]*$', 1)""")
def q_xedges(spark, sf):
    """Parent -> child edges of the frequency tree."""
    return dom.xpath_edges(dom.xpath_document_frequency(_pages(spark, sf), max_depth=20, min_freq=0.01))


_LCC = """, x AS (SELECT *, regexp_extract(path, '^([^/]*/[^/]*)', 1) AS component FROM f),
s AS (SELECT label, component, count(*) AS size FROM x GROUP BY label, component),
b AS (SELECT label, component FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, component DESC) rn FROM s) WHERE rn = 1),
n AS (SELECT x.label, x.component, x.path, x.freq FROM x JOIN b USING (label, component))"""


@register("xpath_largest_component", sql=_freq_sql(20, 0.01) + _LCC +
          "\nSELECT label::BIGINT AS label, component, path, round(freq, 6) AS freq FROM n")
def q_xlcc(spark, sf):
    """Nodes of the largest connected component per class."""
    return dom.xpath_largest_component(dom.xpath_document_frequency(_pages(spark, sf), max_depth=20, min_freq=0.01))


@register("xpath_grid_run", sql=f"""WITH {PAGES_L}, {EV}, {PLAIN},
d AS (SELECT era, label, list_distinct(list_transform(paths, lambda x: '[document]/' || x)) AS paths FROM pp WHERE html IS NOT NULL),
tot AS (SELECT era, label, count(*) AS docs FROM d GROUP BY era, label),
c AS (SELECT era, label, path, count(*) AS pages, len(string_split(path, '/')) - 1 AS anc
      FROM (SELECT era, label, unnest(paths) AS path FROM d) GROUP BY era, label, path),
g AS (SELECT * FROM (VALUES (5, 0.02::DOUBLE), (10, 0.01::DOUBLE), (20, 0.005::DOUBLE)) AS t(max_depth, min_freq))
SELECT g.max_depth::BIGINT AS max_depth, round(g.min_freq::DOUBLE, 6) AS min_freq, c.era, c.label::BIGINT AS label, c.path,
  round(c.pages / tot.docs, 6) AS freq
FROM c JOIN tot USING (era, label) JOIN g ON c.anc <= g.max_depth AND c.pages / tot.docs >= g.min_freq""")
def q_xgrid(spark, sf):
    """The frequency tree over the depth / share grid, per dataset (era) and class."""
    return dom.xpath_grid_run(_pages(spark, sf), dataset="era")


@register("xpath_leaf_counts", sql=_freq_sql(20, 0.01) + _LCC + """,
leaves AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n k WHERE k.label = n.label
           AND regexp_extract(k.path, '^(.*)/[^/]*$', 1) = n.path)),
pre AS (SELECT label, array_to_string(list_slice(parts, 1, i), '/') AS path
        FROM (SELECT label, string_split(path, '/') AS parts FROM leaves), range(2, len(parts) + 1) AS r(i))
SELECT pre.label::BIGINT AS label, pre.path, count(*)::BIGINT AS leaves FROM pre JOIN n USING (label, path)
GROUP BY pre.label, pre.path""")
def q_xleaf(spark, sf):
    """Leaves beneath each node of the largest component."""
    f = dom.xpath_document_frequency(_pages(spark, sf), max_depth=20, min_freq=0.01)
    return dom.xpath_leaf_counts(dom.xpath_largest_component(f))


_AVG = ", ".join(f"avg(len(list_filter(ev, lambda e: NOT e.closing AND e.name = '{t}'))) AS \"{t}\""
                 for t in DF.TARGET_TAGS)


@register("avg_tags_per_page", sql=f"""WITH {PAGES_L}, {EV},
a AS (SELECT label, {_AVG} FROM evs GROUP BY label)
SELECT label::BIGINT AS label, tag, round(avg_count, 6) AS avg_count FROM a
UNPIVOT (avg_count FOR tag IN ({', '.join(f'"{t}"' for t in DF.TARGET_TAGS)}))""")
def q_avg_tags(spark, sf):
    """Average count of seven target tags per page, by class."""
    return dom.avg_tags_per_page(_pages(spark, sf))


_ADV_SRC = "(SELECT page_id, url, coalesce(html, '') AS html FROM pages)"
_ADV_EV = f"evs AS ({S.events_cte(_ADV_SRC)})"
_A = "list_filter(ev, lambda e: NOT e.closing AND e.name = 'a')"
_O = "list_filter(ev, lambda e: NOT e.closing)"
_HREF_PRESENT = "regexp_matches(e.attrs, '(?i)(^|\\s)href\\s*=')"


@register("advanced_html_features", sql=f"""WITH {_ADV_EV}
SELECT page_id,
  round(CASE WHEN len({_A}) > 0 THEN len(list_filter({_A}, lambda e: {S.attr('e.attrs', 'href')} IN ('#', 'javascript:void(0)', ''))) / len({_A}) ELSE 0.0 END, 6) AS dead_link_ratio,
  round(CASE WHEN length(html) > 0 THEN length(array_to_string(list_filter(list_transform(string_split_regex(bh, '<[^>]*>'), lambda s: {S.strip_ws(S.one_char('s'))}), lambda s: s <> ''), ' ')) / length(html) ELSE 0.0 END, 6) AS text_to_code_ratio,
  round(CASE WHEN len({_O}) > 0 THEN len(list_filter({_O}, lambda e: e.name = 'input')) * 100.0 / len({_O}) ELSE 0.0 END, 6) AS input_density,
  round(CASE WHEN len(list_filter({_A}, lambda e: {_HREF_PRESENT})) > 0 THEN
     len(list_filter({_A}, lambda e: {_HREF_PRESENT} AND starts_with(lower({S.attr('e.attrs', 'href')}), 'http'))) / len(list_filter({_A}, lambda e: {_HREF_PRESENT})) ELSE 0.0 END, 6) AS eda_link_ratio,
  len(list_filter({_O}, lambda e: regexp_matches(replace({S.attr('e.attrs', 'style')}, ' ', ''), 'display:none|visibility:hidden')))::BIGINT AS inline_hidden_elements
FROM evs""")
def q_adv_html(spark, sf):
    """Dead links, text-to-code, input density, absolute-link
    ratio, inline hidden elements (from the tag events)."""
    return dom.advanced_html_features(P.table(spark, sf, "pages"))
