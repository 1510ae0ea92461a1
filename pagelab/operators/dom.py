"""D: tag events, tag sequences, zones, XPath sequences and the per-class
XPath frequency tree.

Per-page work (events, paths, zones) runs inside the row with array
functions. Cross-page work aggregates *distinct (page, path)* pairs produced
inside each row, so the shuffle carries at most one row per page and path and
partial aggregation collapses hot paths before the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelab.functions import dom
from pagelab.functions.html import one_char_entities, strip_ws

DOC_NODE = "[document]"
GRID = [(5, 0.02), (10, 0.01), (20, 0.005)]


def with_paths(df: DataFrame, html: str = "html", out: str = "paths", mode: str = "repair") -> DataFrame:
    """Add the full element paths (root included) of each page."""
    x = dom.with_events(df, html, "_ev")
    return x.withColumn(out, F.expr(dom.xpath_sql("_ev", mode))).drop("_ev")


def tag_events(df: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """One row per tag event: (key, pos, tag, kind in open/close/void)."""
    x = dom.with_events(df.select(key, html), html, "ev")
    e = x.select(key, F.posexplode("ev").alias("pos", "e"))
    kind = F.when(F.col("e.closing"), "close").when(F.col("e.void"), "void").otherwise("open")
    return e.select(key, "pos", F.col("e.name").alias("tag"), kind.alias("kind"))


def tag_sequence(df: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Space-joined opening tags of the lower-cased page."""
    t = dom.tag_sequence(html)
    return df.select(key, F.array_join(t, " ").alias("tag_seq"), F.size(t).alias("n_tags"))


def spatial_zones(df: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Top / middle / bottom thirds of the tag sequence."""
    x = df.select(key, dom.tag_sequence(html).alias("_t"))
    z1, z2, z3 = dom.spatial_zones("_t")
    return x.select(key, *[F.array_join(z, " ").alias(f"zone{i}") for i, z in enumerate((z1, z2, z3), 1)],
                    *[F.size(z).alias(f"zone{i}_size") for i, z in enumerate((z1, z2, z3), 1)])


def xpath_sequence(df: DataFrame, html: str = "html", key: str = "page_id", mode: str = "repair") -> DataFrame:
    """D11: '<a/b/c>' path of every descendant of the root, document order."""
    x = with_paths(df.select(key, html), html, mode=mode)
    seq = F.expr(dom.xpath_below_root_sql("paths"))
    return x.select(key, F.array_join(seq, " ").alias("xpath_seq"), F.size(seq).alias("n_paths"))


def _doc_paths(df: DataFrame, keys: list[str], html: str, max_depth: int) -> DataFrame:
    """Distinct document paths per page (document node first), at most
    ``max_depth`` ancestors; pages with NULL HTML are not documents. The tree is
    the plain parser's: no implied end tags."""
    x = with_paths(df.where(F.col(html).isNotNull()).select(*keys, html), html, mode="plain")
    paths = F.array_distinct(F.transform("paths", lambda p: F.concat(F.lit(DOC_NODE + "/"), p)))
    paths = F.filter(paths, lambda p: F.size(F.split(p, "/")) - 1 <= max_depth)
    return x.select(*keys, paths.alias("paths"))


def path_counts(df: DataFrame, label: str = "label", html: str = "html", max_depth: int = 20,
                dataset: str | None = None) -> DataFrame:
    """([dataset,] label, path, pages, docs, n_ancestors): pages holding each path."""
    keys = [dataset, label] if dataset else [label]
    d = _doc_paths(df, keys, html, max_depth)
    docs = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"))
    cnt = d.select(*keys, F.explode("paths").alias("path")).groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("pages"))
    # one row per class on the small side
    return (cnt.join(F.broadcast(docs), keys)
               .withColumn("n_ancestors", F.size(F.split("path", "/")) - 1))


def xpath_document_frequency(df: DataFrame, label: str = "label", html: str = "html",
                             max_depth: int = 20, min_freq: float = 0.01) -> DataFrame:
    """Per class, the share of pages containing each path, kept when
    the share is at least ``min_freq``."""
    c = path_counts(df, label, html, max_depth)
    return (c.withColumn("freq", F.col("pages") / F.col("docs")).where(F.col("freq") >= min_freq)
             .select(label, "path", "pages", "freq"))


def xpath_edges(freq: DataFrame, label: str = "label") -> DataFrame:
    """Parent -> child edges among kept nodes, weight = child share."""
    child = freq.select(label, F.col("path").alias("child"), F.col("freq").alias("weight"),
                        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("parent"))
    parent = freq.select(label, F.col("path").alias("parent"))
    return child.join(parent, [label, "parent"], "inner").select(label, "parent", "child", "weight")


def xpath_largest_component(freq: DataFrame, label: str = "label") -> DataFrame:
    """Nodes of the largest weakly connected component per class.

    A kept path implies its parent is kept (a page holding a path holds its
    prefixes), so components are exactly the groups sharing the first two
    steps (document node + root element)."""
    x = freq.withColumn("component", F.regexp_extract("path", r"^([^/]*/[^/]*)", 1))
    sizes = x.groupBy(label, "component").agg(F.count(F.lit(1)).alias("size"))
    best = sizes.groupBy(label).agg(F.max(F.struct("size", F.col("component").alias("neg"))).alias("b"))
    # ties: the lexically greatest root (one row per class)
    best = best.select(label, F.col("b.neg").alias("component"))
    return x.join(F.broadcast(best), [label, "component"], "inner").select(label, "component", "path", "freq")


def xpath_grid_run(df: DataFrame, label: str = "label", html: str = "html", grid=GRID,
                   dataset: str | None = None) -> DataFrame:
    """D12 for each (depth, min_freq) of a grid, per dataset where that
    column is given, from one aggregation at the largest depth."""
    keys = [dataset, label] if dataset else [label]
    c = path_counts(df, label, html, max(d for d, _ in grid), dataset).withColumn("freq", F.col("pages") / F.col("docs"))
    out = None
    for depth, mf in grid:
        g = (c.where((F.col("n_ancestors") <= depth) & (F.col("freq") >= mf))
              .select(F.lit(depth).alias("max_depth"), F.lit(mf).alias("min_freq"), *keys, "path", "freq"))
        out = g if out is None else out.unionByName(g)
    return out


def xpath_leaf_counts(nodes: DataFrame, label: str = "label") -> DataFrame:
    """Number of leaves beneath (or at) each node of a path tree."""
    kids = nodes.select(label, F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path")).distinct()
    leaves = nodes.join(kids, [label, "path"], "left_anti")
    parts = F.split("path", "/")
    pref = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    x = leaves.select(label, F.explode(pref).alias("path"))
    cnt = x.groupBy(label, "path").agg(F.count(F.lit(1)).alias("leaves"))
    return cnt.join(nodes.select(label, "path"), [label, "path"], "inner")


def avg_tags_per_page(df: DataFrame, label: str = "label", html: str = "html", tags=dom.TARGET_TAGS) -> DataFrame:
    """Mean count per page of each target element, by class."""
    x = dom.with_events(df.select(label, html), html, "ev")
    def count_of(t):
        return F.size(F.filter("ev", lambda e: (~e["closing"]) & (e["name"] == F.lit(t))))
    counts = {t: count_of(t) for t in tags}
    per = x.select(label, *[c.alias(t) for t, c in counts.items()])
    agg = per.groupBy(label).agg(*[F.avg(t).alias(t) for t in tags])
    return agg.unpivot([label], list(tags), "tag", "avg_count")


def advanced_html_features(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """C12-C15, C17 from the tag events: dead-link ratio, text-to-code ratio,
    input density, absolute-link ratio, inline-hidden element count."""
    x = df.select(key, F.coalesce(F.col(html), F.lit("")).alias("html"))
    x = x.withColumn("_bh", F.expr(dom.blanked_html_sql("html"))).withColumn("ev", F.expr(dom.events_sql("_bh")))
    opens = F.filter("ev", lambda e: ~e["closing"])
    anchors = F.filter(opens, lambda e: e["name"] == "a")
    x = x.withColumn("_anchors", anchors).withColumn("_opens", opens)
    dead = F.expr(f"size(filter(_anchors, e -> {dom.attr_sql('e.attrs', 'href')} IN ('#', 'javascript:void(0)', '')))")
    has_href = F.expr(r"filter(_anchors, e -> e.attrs rlike '(?i)(^|\\s)href\\s*=')")
    ext = F.expr(f"size(filter(_anchors, e -> e.attrs rlike '(?i)(^|\\\\s)href\\\\s*=' AND "
                 f"startswith(lower({dom.attr_sql('e.attrs', 'href')}), 'http')))")
    text_nodes = F.filter(F.transform(F.split("_bh", "<[^>]*>"), lambda s: strip_ws(one_char_entities(s))), lambda s: s != "")
    hidden = F.expr(f"size(filter(_opens, e -> replace({dom.attr_sql('e.attrs', 'style')}, ' ', '') rlike "
                    f"'display:none|visibility:hidden'))")
    n_a = F.size("_anchors")
    n_el = F.size("_opens")
    return x.select(
        key,
        F.when(n_a > 0, dead / n_a).otherwise(F.lit(0.0)).alias("dead_link_ratio"),
        F.when(F.length("html") > 0, F.length(F.array_join(text_nodes, " ")) / F.length("html")).otherwise(F.lit(0.0)).alias("text_to_code_ratio"),
        F.when(n_el > 0, F.size(F.filter("_opens", lambda e: e["name"] == "input")) * 100.0 / n_el).otherwise(F.lit(0.0)).alias("input_density"),
        F.when(F.size(has_href) > 0, ext / F.size(has_href)).otherwise(F.lit(0.0)).alias("eda_link_ratio"),
        hidden.alias("inline_hidden_elements"))
