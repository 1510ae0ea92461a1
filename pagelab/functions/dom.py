"""DOM structure of a page as array expressions evaluated inside the row.

The tree is not materialised. A page becomes an ordered list of tag events
(after comments are dropped and script/style bodies blanked), and the tree
walk is a left fold over that list with a stack (``aggregate`` higher-order
function): an opening tag is an element at the current stack height and is
pushed unless void or self-closing; a closing tag pops up to and including its
most recent match (unmatched closing tags are ignored). Two modes tell what an
opening tag does first: ``repair`` applies HTML's implied end tags (``IMPLIED``:
``li``, ``tr``, ``td``, ``option``, ``dt``, ``p`` and their kin end an open
element of their kind, up to the containers that bound them), ``plain`` nests
every unclosed element, as a parser without that knowledge does. Everything
stays in the JVM and needs no shuffle: the work per page is bounded by the page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# HTML void elements (HTML Living Standard) never hold children.
# ---------------------------------------------------------------------------
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input",
             "link", "meta", "param", "source", "track", "wbr"]
# start tags that close an open <p> (HTML parsing rule for implied end tags)
P_CLOSERS = ["address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset",
             "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
             "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
             "table", "ul"]
# implied end tags: (start tags, the open elements they end, the containers that bound the search)
IMPLIED = [
    (P_CLOSERS, ["p"], ["button", "caption", "object", "table", "td", "template", "th"]),
    (["li"], ["li"], ["menu", "ol", "ul"]),
    (["dd", "dt"], ["dd", "dt"], ["dl"]),
    (["optgroup", "option"], ["option"], ["datalist", "select"]),
    (["tbody", "tfoot", "thead"], ["tbody", "td", "tfoot", "th", "thead", "tr"], ["table"]),
    (["tr"], ["td", "th", "tr"], ["table", "tbody", "tfoot", "thead"]),
    (["td", "th"], ["td", "th"], ["table", "tr"]),
]
# tags whose src/href counts as an external resource, and the variant set
RESOURCE_TAGS = ["img", "script", "link"]
RESOURCE_TAGS_WITH_IFRAME = ["img", "script", "link", "iframe"]
# target tags of the per-class average tag count table
TARGET_TAGS = ["div", "span", "a", "script", "form", "input", "iframe"]
# ---------------------------------------------------------------------------

BLANK_COMMENTS_RE = r"(?s)<!--.*?-->"
BLANK_SCRIPT_RE = r"(?is)<script(\b[^>]*)>.*?</script\s*>"
BLANK_STYLE_RE = r"(?is)<style(\b[^>]*)>.*?</style\s*>"
# tag name, then attributes: unquoted stretches around whole quoted values
EVENT_RE = r"""<(/?[a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>"""
# a slash ends a tag only after white space, a quote or the tag's name
SELF_CLOSING_RE = r"""(^|[\s"'])/$"""
OPEN_TAG_SEQ_RE = r"<([a-zA-Z0-9]+)[^>]*>"
SCRIPT_BODY_RE = r"(?is)<script\b[^>]*>(.*?)</script\s*>"


def sql_str(s: str) -> str:
    """A Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_list(xs) -> str:
    return ", ".join(sql_str(x) for x in xs)


def blanked_html_sql(html: str = "html") -> str:
    """Comments removed, script/style bodies emptied (attributes kept)."""
    h = f"coalesce({html}, '')"
    h = f"regexp_replace({h}, {sql_str(BLANK_COMMENTS_RE)}, '')"
    h = f"regexp_replace({h}, {sql_str(BLANK_SCRIPT_RE)}, '<script$1></script>')"
    h = f"regexp_replace({h}, {sql_str(BLANK_STYLE_RE)}, '<style$1></style>')"
    return h


def events_sql(blanked: str = "bh") -> str:
    """array<struct<name, attrs, closing, void>> in document order, over a
    column holding :func:`blanked_html_sql`."""
    return f"""zip_with(
        regexp_extract_all({blanked}, {sql_str(EVENT_RE)}, 1),
        regexp_extract_all({blanked}, {sql_str(EVENT_RE)}, 2),
        (n, a) -> named_struct(
            'name', lower(regexp_replace(n, '^/', '')),
            'attrs', a,
            'closing', startswith(n, '/'),
            'void', lower(n) IN ({_sql_list(VOID_TAGS)}) OR a rlike {sql_str(SELF_CLOSING_RE)}))"""


def with_events(df, html: str = "html", out: str = "ev"):
    """Add the tag-event array column (and drop the helper column)."""
    return (df.withColumn("_bh", F.expr(blanked_html_sql(html)))
              .withColumn(out, F.expr(events_sql("_bh"))).drop("_bh"))


def _pop_sql(stack: str, name: str) -> str:
    # drop the most recent matching entry and everything above it
    pos = f"array_position(reverse({stack}), {name})"
    return (f"CASE WHEN {pos} = 0 THEN {stack} "
            f"ELSE slice({stack}, 1, size({stack}) - {pos}) END")


def _cut_sql(stack: str, ends: list[str], bounds: list[str]) -> str:
    # keep the stack below the lowest element of ``ends`` above the last of ``bounds``
    bound = f"coalesce(array_max(transform({stack}, (t, i) -> if(t IN ({_sql_list(bounds)}), i + 1, 0))), 0)"
    return (f"transform(array({bound}), b -> transform(array(array_min(transform({stack}, (t, i) -> "
            f"if(i >= b AND t IN ({_sql_list(ends)}), i, NULL)))), k -> "
            f"if(k IS NULL, {stack}, slice({stack}, 1, k)))[0])[0]")


def _pre_sql(stack: str, name: str, mode: str) -> str:
    # stack that an opening tag finds
    if mode == "plain":
        return stack
    if mode != "repair":
        raise ValueError("mode is 'repair' or 'plain'")
    rules = " ".join(f"WHEN {name} IN ({_sql_list(tags)}) THEN {_cut_sql(stack, ends, bounds)}"
                     for tags, ends, bounds in IMPLIED)
    return f"CASE {rules} ELSE {stack} END"


def _fold_sql(ev: str, init: str, step: str, result: str, mode: str) -> str:
    """Fold over the events; ``step`` sees acc, e and s, the stack before the event."""
    return f"""aggregate({ev}, {init},
        (acc, e) -> transform(array(CASE WHEN e.closing THEN {_pop_sql('acc.stack', 'e.name')}
                                         ELSE {_pre_sql('acc.stack', 'e.name', mode)} END), s -> {step})[0],
        acc -> {result})"""


_NEXT = "CASE WHEN e.closing OR e.void THEN s ELSE array_append(s, e.name) END"


def depth_sql(ev: str, mode: str = "repair") -> str:
    """Maximum element level (root = 0); 0 when the page has no element."""
    return _fold_sql(ev, "named_struct('stack', cast(array() AS array<string>), 'mx', 0)",
                     f"named_struct('stack', {_NEXT}, 'mx', if(e.closing, acc.mx, greatest(acc.mx, size(s))))",
                     "acc.mx", mode)


def xpath_sql(ev: str, mode: str = "repair", chunk: int = 256) -> str:
    """Full path (root included, '/'-joined) of every element in document order.
    Paths gather in chunks that are joined once, so a page costs its tags and
    not their square."""
    path = "array_join(array_append(s, e.name), '/')"
    full = f"size(acc.cur) >= {chunk}"
    return _fold_sql(
        ev, "named_struct('stack', cast(array() AS array<string>), 'cur', cast(array() AS array<string>), "
            "'done', cast(array() AS array<array<string>>))",
        f"named_struct('stack', {_NEXT}, "
        f"'cur', CASE WHEN e.closing THEN acc.cur WHEN {full} THEN array({path}) ELSE array_append(acc.cur, {path}) END, "
        f"'done', CASE WHEN e.closing OR NOT {full} THEN acc.done ELSE array_append(acc.done, acc.cur) END)",
        "concat(flatten(acc.done), acc.cur)", mode)


def xpath_below_root_sql(paths: str) -> str:
    """Paths of the root's descendants, root step dropped, wrapped in <...>."""
    return (f"transform(filter({paths}, p -> instr(p, '/') > 0), "
            f"p -> concat('<', substring(p, instr(p, '/') + 1), '>'))")


def attr_sql(attrs: str, name: str) -> str:
    """Value of an attribute inside a tag's attribute text ('' if absent);
    quoted values may hold spaces."""
    pat = r"""(?i)(?:^|[\s/])""" + name + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return (f"concat(regexp_extract({attrs}, {sql_str(pat)}, 1), regexp_extract({attrs}, {sql_str(pat)}, 2), "
            f"regexp_extract({attrs}, {sql_str(pat)}, 3))")


def tree_features_sql(html: str = "html", url_domain: str = "domain") -> dict[str, str]:
    """Structural-vector columns 22-28 as Spark SQL expressions over a
    column ``ev`` holding :func:`events_sql` and a page-domain column."""
    opens = "filter(ev, e -> NOT e.closing)"
    res = f"filter({opens}, e -> e.name IN ({_sql_list(RESOURCE_TAGS)}))"
    src = (f"coalesce(nullif({attr_sql('e.attrs', 'src')}, ''), {attr_sql('e.attrs', 'href')})")
    ext = f"size(filter({res}, e -> startswith({src}, 'http') AND NOT contains({src}, {url_domain})))"
    act = attr_sql("e.attrs", "action")
    act_dom = f"lower(regexp_extract({act}, {sql_str('^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)')}, 1))"
    foreign = (f"exists(filter({opens}, e -> e.name = 'form'), e -> startswith({act}, 'http') "
               f"AND {act_dom} <> {url_domain} AND NOT endswith({act_dom}, concat('.', {url_domain})))")
    js = (f"aggregate(regexp_extract_all(coalesce({html}, ''), {sql_str(SCRIPT_BODY_RE)}, 1), 0L, "
          f"(a, s) -> a + length(s))")
    return {
        "dom_depth": depth_sql("ev"),
        "tag_diversity": f"size(array_distinct(transform({opens}, e -> e.name)))",
        "external_resource_ratio": f"CASE WHEN size({res}) = 0 THEN 0D ELSE {ext} / size({res}) END",
        "foreign_form_action": f"CAST({foreign} AS INT)",
        "html_js_ratio": f"{js} / greatest(length(coalesce({html}, '')), 1)",
        "body_tag_count": f"size(filter({opens}, e -> e.name NOT IN ('html', 'head')))",
        "iframe_count": f"size(filter({opens}, e -> e.name = 'iframe'))",
    }


def tag_sequence(html="html") -> Column:
    """Opening tag names of the lower-cased raw page, in order."""
    h = F.lower(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")))
    return F.regexp_extract_all(h, F.lit(OPEN_TAG_SEQ_RE), 1)


def spatial_zones(tags) -> tuple[Column, Column, Column]:
    """Three slices of the tag list: chunk = max(1, n div 3); zone 3 takes
    the remainder."""
    t = F.col(tags) if isinstance(tags, str) else tags
    n = F.size(t)
    chunk = F.greatest(F.floor(n / 3).cast("int"), F.lit(1))
    return (F.slice(t, 1, chunk),
            F.slice(t, chunk + 1, chunk),
            F.slice(t, 2 * chunk + 1, F.greatest(n - 2 * chunk, F.lit(0))))
