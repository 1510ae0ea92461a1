"""DuckDB SQL fragments for the oracle queries.

These are written independently of the Spark expressions (different engine,
often a different formulation: entropy by grouping characters, tag events by
``list_reduce``) and serve only as the correctness oracle.
"""

from __future__ import annotations

from pagelab.functions.dom import IMPLIED, RESOURCE_TAGS, VOID_TAGS
from pagelab.functions.html import ERROR_SIGNATURES, TITLE_STOP_WORDS
from pagelab.functions.url import (EDA_BRANDS, LEXICAL_SPECIAL_CHARS, PHISH_KEYWORDS,
                                   SUSPICIOUS_TLDS, TOP_BRANDS)

SCHEME = "'^([a-zA-Z][a-zA-Z0-9+.-]*)://'"
NETLOC = "'^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)'"
PATHR = "'^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)'"
WS = r"[\t\n\x0B\f\r ]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def qlist(xs) -> str:
    return ", ".join(q(x) for x in xs)


def with_http(u):
    return f"(CASE WHEN starts_with({u}, 'http') THEN {u} ELSE 'http://' || {u} END)"


def netloc(u):
    return f"regexp_extract({u}, {NETLOC}, 1)"


def scheme(u):
    return f"lower(regexp_extract({u}, {SCHEME}, 1))"


def path(u):
    return (f"(CASE WHEN regexp_matches({u}, {SCHEME}) THEN regexp_extract({u}, {PATHR}, 1) "
            f"ELSE regexp_extract({u}, '^([^?#]*)', 1) END)")


def cnt(s, ch):
    return f"((length({s}) - length(replace({s}, {q(ch)}, ''))) // {len(ch)})"


def cnt_re(s, pat):
    return f"(length({s}) - length(regexp_replace({s}, {q(pat)}, '', 'g')))"


def n_match(s, pat):
    return f"len(regexp_extract_all({s}, {q(pat)}))"


def subdomains(h):
    return f"greatest(len(string_split({h}, '.')) - 2, 0)"


def entropy(s):
    # independent formulation: group the characters, -sum p log2 p
    return (f"coalesce((SELECT -sum((c / length({s})) * log2(c / length({s}))) FROM "
            f"(SELECT count(*)::DOUBLE AS c FROM unnest(string_split({s}, '')) AS _t(ch) GROUP BY ch)), 0.0)")


def strip_ws(s):
    return f"regexp_replace({s}, '^{WS}+|{WS}+$', '', 'g')"


def structural_url(u="url") -> dict[str, str]:
    u2 = with_http(u)
    h = netloc(u2)
    p = path(u2)
    stripped = f"regexp_replace({p}, '^/+|/+$', '', 'g')"
    return {
        "url_length": f"length({u})",
        "url_num_dots": cnt(h, "."),
        "is_https": f"CAST({scheme(u2)} = 'https' AS INTEGER)",
        "url_num_special_chars": f"length(regexp_replace({u}, '[\\p{{L}}\\p{{N}}]', '', 'g'))",
        "url_digit_ratio": f"{cnt_re(u, '[0-9]')} / greatest(length({u}), 1)",
        "url_num_subdomains": subdomains(h),
        "url_entropy": entropy(u),
        "url_path_depth": f"(CASE WHEN {p} = '' THEN 0 ELSE len(string_split({stripped}, '/')) END)",
        "url_has_login": f"CAST(contains(lower({u}), 'login') AS INTEGER)",
        "url_hyphen_domain": f"CAST(contains({h}, '-') AS INTEGER)",
    }


def lexical_url(u="url") -> dict[str, str]:
    ul = with_http(f"lower({u})")
    d = netloc(ul)
    p = path(ul)
    labels = f"string_split({d}, '.')"
    tld = f"(CASE WHEN contains({d}, '.') THEN '.' || {labels}[-1] ELSE '' END)"
    root = f"(CASE WHEN len({labels}) >= 2 THEN array_to_string({labels}[-2:], '.') ELSE {d} END)"
    brand = " OR ".join(f"(contains({ul}, {q(b)}) AND NOT contains({root}, {q(b)}))" for b in TOP_BRANDS)
    return {
        "url_length": f"length({u})",
        "url_num_dots": cnt(u, "."),
        "url_num_special_chars": "(" + " + ".join(cnt(u, c) for c in LEXICAL_SPECIAL_CHARS) + ")",
        "url_digit_ratio": f"{cnt_re(u, '[0-9]')} / greatest(length({u}), 1)",
        "url_num_subdomains": subdomains(d),
        "url_path_depth": cnt(p, "/"),
        "url_hyphen_domain": f"CAST(contains({d}, '-') AS INTEGER)",
        "domain_entropy": entropy(d),
        "tld_suspiciousness": f"CAST({tld} IN ({qlist(SUSPICIOUS_TLDS)}) AS INTEGER)",
        "brand_impersonation": f"CAST(({brand}) AS INTEGER)",
        "keyword_stuffing_score": "(" + " + ".join(cnt(ul, k) for k in PHISH_KEYWORDS) + ")",
    }


def manual_url(u="url") -> dict[str, str]:
    h = netloc(u)
    p = path(u)
    rp = f"strpos(reverse({u}), '//')"
    last = f"(CASE WHEN {rp} = 0 THEN -1 ELSE length({u}) - {rp} - 1 END)"
    return {
        "m_length": f"length({u})",
        "m_dots": cnt(u, "."), "m_hyphens": cnt(u, "-"), "m_underscores": cnt(u, "_"),
        "m_slashes": cnt(u, "/"), "m_questions": cnt(u, "?"), "m_equals": cnt(u, "="),
        "m_ampersands": cnt(u, "&"),
        "m_digits": cnt_re(u, "[0-9]"),
        "m_letters": cnt_re(u, r"\p{L}"),
        "m_is_ip": f"CAST(regexp_matches({u}, '([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}') AS INTEGER)",
        "m_has_at": f"CAST(contains({u}, '@') AS INTEGER)",
        "m_double_slash": f"CAST({last} > 7 AS INTEGER)",
        "m_depth": f"len(list_filter(string_split({p}, '/'), lambda s: s <> ''))",
        "m_https": f"CAST({scheme(u)} = 'https' AS INTEGER)",
        "m_subdomains": subdomains(h),
    }


def eda_url(u="url") -> dict[str, str]:
    ul = f"lower({u})"
    brand = " OR ".join(f"contains({ul}, {q(b)})" for b in EDA_BRANDS)
    return {
        "eda_url_length": f"length({ul})",
        "eda_url_depth": cnt(ul, "/"),
        "eda_num_dots": cnt(ul, "."),
        "eda_digit_ratio": f"(CASE WHEN length({ul}) > 0 THEN {cnt_re(ul, '[0-9]')} / length({ul}) ELSE 0.0 END)",
        "eda_has_ip": f"CAST(regexp_matches({ul}, '([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}') AS INTEGER)",
        "eda_brand_in_url": f"CAST(({brand}) AS INTEGER)",
    }


# ------------------------------------------------------------------ HTML
HREF = r"""href=['"]?([^'" >]+)"""


def title(h):
    return strip_ws(f"regexp_extract({h}, '(?is)<title[^>]*>(.*?)</title>', 1)")


def pattern_html(u="url", h="html") -> dict[str, str]:
    hl = f"lower({h})"
    dom = netloc(with_http(u))
    links = f"regexp_extract_all({hl}, {q(HREF)}, 1)"
    ext = f"len(list_filter({links}, lambda l: starts_with(l, 'http') AND NOT contains(l, {dom})))"
    return {
        "html_length": f"length({h})",
        "html_num_tags": n_match(h, "<[^>]+>"),
        "html_text_ratio": f"length(regexp_replace({h}, '<[^>]+>', '', 'g')) / greatest(length({h}), 1)",
        "html_script_count": cnt(hl, "<script"),
        "html_external_link_ratio": f"{ext} / greatest(len({links}), 1)",
        "html_password_input_count": n_match(hl, r"""<input[^>]+type=['"]?password['"]?"""),
        "html_empty_link_ratio": f"{n_match(hl, '<a[^>]+href=')} / greatest(len({links}), 1)",
        "html_input_to_p_ratio": f"({cnt(hl, '<input')} + {cnt(hl, '<button')}) / greatest({cnt(hl, '<p>')}, 1)",
        "css_hidden_count": n_match(hl, r"display:\s*none|visibility:\s*hidden|opacity:\s*0"),
        "html_title_length": f"length({title(h)})",
    }


def brand_lev(u="url", h="html"):
    t = f"lower({title(h)})"
    for w in TITLE_STOP_WORDS:
        t = f"replace({t}, {q(w)}, '')"
    t = f"regexp_replace({t}, '[^a-z0-9]', '', 'g')"
    d = f"regexp_replace({netloc(with_http(u))}, '[^a-z0-9]', '', 'g')"
    return (f"(CASE WHEN {t} = '' THEN 0.0 WHEN length({t}) > 3 AND contains({d}, {t}) THEN 0.0 "
            f"ELSE levenshtein({t}, {d}) / greatest(length({t}), length({d})) END)")


def brand_ratio_ctes() -> str:
    """CTEs up to sm_brand(page_id, bd): the brand discrepancy by matching blocks (domains
    under 200 characters, where no character is popular). ``sm_run`` holds the length of the common
    run from (i, j) on; ``sm_range`` cuts each range at its longest block, the first of several."""
    t = f"lower({title('html')})"
    for x in TITLE_STOP_WORDS:
        t = f"replace({t}, {q(x)}, '')"
    return f"""sm_text AS MATERIALIZED (SELECT page_id, regexp_replace({t}, '[^a-z0-9]', '', 'g') AS t,
    regexp_replace({netloc(with_http('url'))}, '[^a-z0-9]', '', 'g') AS d FROM pages),
sm_eq AS (SELECT page_id, i, j FROM sm_text, range(1, length(t) + 1) AS a(i), range(1, length(d) + 1) AS b(j)
  WHERE substr(t, i, 1) = substr(d, j, 1)),
sm_isle AS (SELECT *, i - row_number() OVER (PARTITION BY page_id, i - j ORDER BY i) AS isle FROM sm_eq),
sm_run AS MATERIALIZED (SELECT page_id, i, j, count(*) OVER (PARTITION BY page_id, i - j, isle ORDER BY i DESC) AS n FROM sm_isle),
sm_range(page_id, alo, ahi, blo, bhi, got) AS (
  SELECT page_id, 1::BIGINT, length(t) + 1, 1::BIGINT, length(d) + 1, 0::BIGINT FROM sm_text
  UNION ALL
  SELECT page_id, CASE WHEN side = 0 THEN alo ELSE i + k END, CASE WHEN side = 0 THEN i ELSE ahi END,
    CASE WHEN side = 0 THEN blo ELSE j + k END, CASE WHEN side = 0 THEN j ELSE bhi END, CASE WHEN side = 0 THEN k ELSE 0 END
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id, alo, blo ORDER BY k DESC, i, j) AS best FROM (
    SELECT r.page_id, alo, ahi, blo, bhi, i, j, least(n, ahi - i, bhi - j) AS k FROM sm_range r JOIN sm_run
      ON r.page_id = sm_run.page_id AND i >= alo AND i < ahi AND j >= blo AND j < bhi)), (VALUES (0), (1)) AS sides(side)
  WHERE best = 1),
sm_brand AS (SELECT page_id, CASE WHEN t = '' OR (length(t) > 3 AND contains(d, t)) THEN 0.0
  ELSE 1 - 2.0 * m / (length(t) + length(d)) END AS bd FROM sm_text JOIN (SELECT page_id, sum(got) AS m FROM sm_range GROUP BY page_id) USING (page_id))"""


def title_link_list() -> str:
    """URL parts + stripped title, anchor and list text."""
    u2 = with_http("url")
    url_part = (f"replace(replace(concat_ws(' ', {scheme(u2)}, {netloc(u2)}, {path(u2)}, "
                f"regexp_extract({u2}, '\\?([^#]*)', 1)), '.', ' '), '/', ' ')")

    def block(pat):
        return strip_ws(f"regexp_replace(array_to_string(regexp_extract_all(coalesce(html, ''), '{pat}', 1), ' '), '<[^>]+>', ' ', 'g')")
    titles = block("(?is)<title[^>]*>(.*?)</title>")
    links = block("(?is)<a[^>]*>(.*?)</a>")
    lists = block("(?is)<(?:ul|ol|li)[^>]*>(.*?)</(?:ul|ol|li)>")
    html_part = f"(CASE WHEN length(coalesce(html, '')) > 5 THEN concat_ws(' ', {titles}, {links}, {lists}) ELSE '' END)"
    return f"concat_ws(' ', {url_part}, {html_part})"


# character references by what they stand for: white space, anything
SPACE_REF = "'&(nbsp|ensp|emsp|thinsp);|&#(9|10|12|13|32|160);|&#[xX](9|[aAcCdD]|20|[aA]0);'"
ANY_REF = "'&([a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);'"


def one_char(x):
    return f"regexp_replace(regexp_replace({x}, {SPACE_REF}, ' ', 'g'), {ANY_REF}, '*', 'g')"


def letters(x):
    """Numeric references to ASCII letters as these letters, in lower-case text."""
    for low in range(97, 123):
        x = f"regexp_replace({x}, '&#0*({low - 32}|{low});|&#x0*({low - 32:x}|{low:x});', '{chr(low)}', 'g')"
    return x


def no_refs(x):
    return f"regexp_replace(regexp_replace({x}, {SPACE_REF}, ' ', 'g'), {ANY_REF}, '', 'g')"


# ------------------------------------------------------------------ DOM
def blanked(h="html"):
    x = f"coalesce({h}, '')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<script(\\b[^>]*)>.*?</script\\s*>', '<script\\1></script>', 'g')"
    x = f"regexp_replace({x}, '(?is)<style(\\b[^>]*)>.*?</style\\s*>', '<style\\1></style>', 'g')"
    return x


# name up to white space, slash or >; attributes end at the first > outside quotes
EV_RE = q("""<(/?[a-zA-Z][^\\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>""")


def events(bh="bh"):
    """list of struct(name, attrs, closing, void) over a blanked-page column."""
    return (f"list_transform(list_zip(regexp_extract_all({bh}, {EV_RE}, 1), regexp_extract_all({bh}, {EV_RE}, 2)), "
            f"lambda z: {{'name': lower(regexp_replace(z[1], '^/', '')), 'attrs': z[2], "
            f"'closing': starts_with(z[1], '/'), "
            f"'void': lower(z[1]) IN ({qlist(VOID_TAGS)}) OR z[2] = '/' OR "
            f"(ends_with(z[2], '/') AND right(z[2], 2)[1] IN (' ', chr(9), chr(10), chr(12), chr(13), '\"', ))}})")


def _pop(stack, name):
    pos = f"coalesce(list_position(list_reverse({stack}), {name}), 0)"
    return f"(CASE WHEN {pos} = 0 THEN {stack} ELSE list_slice({stack}, 1, len({stack}) - {pos}) END)"


def _pre(stack, name, mode):
    """Stack after the implied end tags: the lowest element that the start tag
    ends and everything above it go, unless a container lies in between."""
    if mode == "plain":
        return stack
    whens = []
    for tags, ends, bounds in IMPLIED:
        # places (from 1) of what may end, less those below the last container
        last = f"coalesce(list_max(list_transform({stack}, lambda t, i: CASE WHEN t IN ({qlist(bounds)}) THEN i ELSE 0 END)), 0)"
        place = (f"list_min(list_filter(list_transform({stack}, lambda t, i: CASE WHEN t IN ({qlist(ends)}) THEN i ELSE 0 END), "
                 f"lambda i: i > {last}))")
        whens.append(f"WHEN {name} IN ({qlist(tags)}) AND {place} IS NOT NULL THEN list_slice({stack}, 1, {place} - 1)")
    return f"(CASE {' '.join(whens)} ELSE {stack} END)"


def _walk(ev, mode, init, step):
    """Fold over the events; step sees acc, e and acc's stack before the event as s."""
    before = f"(CASE WHEN e.closing THEN {_pop('acc.stack', 'e.name')} ELSE {_pre('acc.stack', 'e.name', mode)} END)"
    return f"list_reduce({ev}, lambda acc, e: list_transform([{before}], lambda s: {step})[1], {init})"


_NEXT = "CASE WHEN e.closing OR e.void THEN s ELSE list_append(s, e.name) END"


def depth(ev="ev", mode="repair"):
    return _walk(ev, mode, "{'stack': []::VARCHAR[], 'mx': 0}",
                 f"{{'stack': {_NEXT}, 'mx': CASE WHEN e.closing THEN acc.mx ELSE greatest(acc.mx, len(s)) END}}") + ".mx"


def xpaths(ev="ev", mode="repair"):
    """Full '/'-joined path (root included) of every element."""
    return _walk(ev, mode, "{'stack': []::VARCHAR[], 'paths': []::VARCHAR[]}",
                 f"{{'stack': {_NEXT}, 'paths': CASE WHEN e.closing THEN acc.paths "
                 f"ELSE list_append(acc.paths, array_to_string(list_append(s, e.name), '/')) END}}") + ".paths"


def attr(a, name):
    pat = f"""'(?i)(?:^|[\\s/]){name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))'"""
    return f"(regexp_extract({a}, {pat}, 1) || regexp_extract({a}, {pat}, 2) || regexp_extract({a}, {pat}, 3))"


def tree(ev="ev", h="html", dom="domain") -> dict[str, str]:
    opens = f"list_filter({ev}, lambda e: NOT e.closing)"
    res = f"list_filter({opens}, lambda e: e.name IN ({qlist(RESOURCE_TAGS)}))"
    src = f"coalesce(nullif({attr('e.attrs', 'src')}, ''), {attr('e.attrs', 'href')})"
    ext = f"len(list_filter({res}, lambda e: starts_with({src}, 'http') AND NOT contains({src}, {dom})))"
    act = attr("e.attrs", "action")
    act_dom = f"lower(regexp_extract({act}, {NETLOC}, 1))"
    foreign = (f"len(list_filter({opens}, lambda e: e.name = 'form' AND starts_with({act}, 'http') "
               f"AND {act_dom} <> {dom} AND NOT ends_with({act_dom}, '.' || {dom}))) > 0")
    js = f"coalesce(list_sum(list_transform(regexp_extract_all(coalesce({h}, ''), '(?is)<script\\b[^>]*>(.*?)</script\\s*>', 1), lambda s: length(s))), 0)"
    has = f"len({opens}) > 0"

    def g(x):
        return f"(CASE WHEN {has} THEN {x} ELSE 0 END)"
    return {
        "dom_depth": g(depth(ev)),
        "tag_diversity": g(f"len(list_distinct(list_transform({opens}, lambda e: e.name)))"),
        "external_resource_ratio": g(f"(CASE WHEN len({res}) = 0 THEN 0.0 ELSE {ext} / len({res}) END)"),
        "foreign_form_action": g(f"CAST({foreign} AS INTEGER)"),
        "html_js_ratio": g(f"{js} / greatest(length(coalesce({h}, '')), 1)"),
        "body_tag_count": g(f"len(list_filter({opens}, lambda e: e.name NOT IN ('html', 'head')))"),
        "iframe_count": g(f"len(list_filter({opens}, lambda e: e.name = 'iframe'))"),
    }


def events_cte(src="pages", extra="") -> str:
    """CTE body adding ``domain`` and ``ev`` to a page table."""
    return (f"SELECT *, {netloc(with_http('url'))} AS domain, {events('bh')} AS ev FROM "
            f"(SELECT *, {blanked('html')} AS bh FROM {src}{extra})")


def error_page(h="html"):
    pat = "(?i)(" + "|".join(ERROR_SIGNATURES) + ")"
    return f"(length({h}) < 2000 AND regexp_matches({h}, {q(pat)}))"
