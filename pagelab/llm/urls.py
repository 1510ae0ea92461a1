"""URL filters with redirect equivalence, with DataFrame operations only.

A rule is (host, path, action): it fits its host and every subdomain when the
URL's path starts with the rule's; the longest fitting rule wins. URLs that
redirects (meta refresh) or canonical links connect are one resource under
several names: components over those edges carry a block from any blocked name
to the names that no rule speaks about. An explicit allow of a URL stands
against a propagated block (``allow_scope='url'``); with ``'class'`` it also
clears the URL's whole component.

Defined cases: a null URL, or one without ``://``, has empty host and path,
fits no rule, joins no component and is allowed; fragments do not tell
resources apart; nulls in html give no edges; repeated URLs share a verdict;
of equally long fitting rules the longer host wins, then allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelab.llm.common import checkpointed, lower_az
from pagelab.llm.components import components

_ATTR = r"""(?is)\s{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_az(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def resource(url: Column) -> Column:
    """The URL less its fragment, scheme and host folded; null unless it has ``://``."""
    whole = F.regexp_extract(url, r"^([^#]*)", 1)
    at = F.instr(whole, "://")
    head = F.regexp_extract(whole, r"^[^/?#]*://[^/?#]*", 0)
    return F.when(at > 0, F.concat(lower_az(head), whole.substr(F.length(head) + 1, F.length(whole))))


def _attribute(tag: Column, name: str) -> Column:
    pattern = _ATTR.format(name)
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def _resolved() -> Column:
    """Column ``link`` as seen from the page at url (scheme, site, folder); dot
    segments stay as they are; links of other kinds (mailto:, #part) are null."""
    url, link, folder = F.col("url"), F.col("link"), F.col("folder")
    return (F.when(link == "", F.lit(None))
            .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat("scheme", link))
            .when(link.startswith("/"), F.concat("site", link))
            .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | link.startswith("#"), F.lit(None))
            .when(link.startswith("?"), F.concat(F.regexp_extract(url, r"^[^?#]*", 0), link))
            .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), link)))


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v): redirect and canonical-link edges between resources, from url and html.
    Comments and scripts do not count."""
    held = pages.where(F.col("html").rlike("(?i)canonical|http-equiv") & F.col("url").contains("://"))
    clean = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    tags = F.regexp_extract_all(clean, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    at = held.select("url", F.explode(tags).alias("tag"))
    # one step per column: an expression that is used twice is computed once
    seen = at.select("url", "tag", F.lower(_attribute(F.col("tag"), "rel")).alias("rel"),
                     F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))).alias("equiv"))
    canonical = F.col("tag").rlike(r"(?i)^<link") & F.col("rel").rlike(r"(^|\s)canonical(\s|$)")
    refresh = F.col("tag").rlike(r"(?i)^<meta") & (F.col("equiv") == "refresh")
    moved = F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?i)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?([^"']*)""", 1)
    found = seen.where(canonical | refresh).select("url", F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, moved).alias("link"))
    found = found.select(
        "url", F.trim(F.regexp_replace("link", r"(?i)&amp;|&#38;", "&")).alias("link"),
        F.regexp_extract("url", r"^([^/?#]*:)//", 1).alias("scheme"),
        F.regexp_extract("url", r"^[^/?#]*://[^/?#]*", 0).alias("site"),
        F.regexp_extract("url", r"^([^/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1).alias("folder"))
    found = checkpointed(found.select("url", _resolved().alias("target")))
    return (found.select(resource(F.col("url")).alias("u"), resource(F.col("target")).alias("v"))
            .where("u IS NOT NULL AND v IS NOT NULL AND u != v").distinct())


def match_rules(rows: DataFrame, rules: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """``rows`` (with host and path) plus rule and action of the longest fitting rule.

    Hosts are looked up by their suffixes, so the rule list may be long; it is
    broadcast only below ``max_broadcast`` rules."""
    listed = rules.where(F.col("host").isNotNull()).select(
        F.col("host").alias("_h"), F.coalesce("path", F.lit("")).alias("_p"), F.col("action").alias("_a"))
    if listed.count() <= max_broadcast:
        listed = F.broadcast(listed)
    names = rows.columns
    # the split host is bound to a lambda variable, so that it is computed once a row
    suffix = F.element_at(F.transform(F.array(F.split("host", r"\.")), lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, i, F.size(w)), "."))), 1)
    tries = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_s", F.explode(suffix))
    met = tries.join(listed, (F.col("_s") == F.col("_h")) & F.col("path").startswith(F.col("_p")), "left")
    best = F.max(F.when(F.col("_h").isNotNull(), F.struct(
        (F.length("_h") + F.length("_p")).alias("n"), F.length("_h").alias("nh"),
        (F.col("_a") == "allow").alias("ok"), F.concat("_h", "_p").alias("rule"), F.col("_a").alias("action"))))
    return (met.groupBy("_row", *names).agg(best.alias("_b"))
            .select(*names, F.col("_b.rule").alias("rule"), F.col("_b.action").alias("action")))


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None,
          allow_scope: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of each page.

    ``edges`` (u, v) adds known redirects between URLs to those found in html."""
    if allow_scope not in ("url", "class"):
        raise ValueError("allow_scope is 'url' or 'class'")
    links = link_edges(pages)
    if edges is not None:
        links = links.union(edges.select(resource(F.col("u")).alias("u"), resource(F.col("v")).alias("v")))
    named = components(links)
    hosts = named.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    ruled = match_rules(hosts, rules)
    state = ruled.groupBy("component").agg(
        F.max((F.col("action") == "block").cast("int")).alias("blocked"),
        F.max((F.col("action") == "allow").cast("int")).alias("allowed"))
    bad = F.col("blocked") == 1
    if allow_scope == "class":
        bad = bad & (F.coalesce("allowed", F.lit(0)) == 0)
    aliases = checkpointed(ruled.select("node", "component")
                           .join(state.where(bad).select("component"), "component", "left_semi")
                           .select(F.col("node").alias("_n")))
    own = match_rules(pages.select("page_id", "url", host_of(F.col("url")).alias("host"),
                                   path_of(F.col("url")).alias("path"), resource(F.col("url")).alias("_node")), rules)
    met = own.join(aliases, F.col("_node") == F.col("_n"), "left")
    verdict = F.coalesce("action", F.when(F.col("_n").isNotNull(), "block").otherwise("allow"))
    return met.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"))
