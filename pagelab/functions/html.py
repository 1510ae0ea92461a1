"""HTML features by pattern (no tree), as Spark column expressions.

All counts are regular-expression counts over the page string; the lower-cased
page is a separate projection so repeated patterns reuse it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelab.functions.url import _c, netloc, with_http

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# words removed from the lower-cased title before comparing it to the domain
TITLE_STOP_WORDS = ["login", "sign in", "secure", "update", "account", "home", "welcome"]
# signatures of server error pages (case-insensitive)
ERROR_SIGNATURES = [
    "404 Not Found", "403 Forbidden", "Access Denied",
    "502 Bad Gateway", "Service Unavailable", "Not Acceptable!",
]
# hrefs that count as dead links
DEAD_HREFS = ["#", "javascript:void(0)", ""]
# ---------------------------------------------------------------------------

TAG_RE = r"<[^>]+>"
HREF_RE = r"""href=['"]?([^'" >]+)"""
PASSWORD_RE = r"""<input[^>]+type=['"]?password['"]?"""
ANCHOR_HREF_RE = r"<a[^>]+href="
EMPTY_HREF_INTENT_RE = (r"""<a[^>]+href=(""|''|"#"|'#'|"javascript:void\(0\)"|'javascript:void\(0\)'"""
                        r"""|#[\s>]|javascript:void\(0\)[\s>])""")
CSS_HIDDEN_RE = r"display:\s*none|visibility:\s*hidden|opacity:\s*0"
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
WS = r"[\t\n\x0B\f\r ]"
CONTROL_CHARS_RE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def strip_ws(s) -> Column:
    """Remove leading and trailing whitespace (space, tab, CR, LF, FF, VT)."""
    return F.regexp_replace(_c(s), f"^{WS}+|{WS}+$", "")


def count_substr(s, sub: str) -> Column:
    s = _c(s)
    return ((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / F.lit(len(sub))).cast("int")


def title_text(html) -> Column:
    return strip_ws(F.regexp_extract(_c(html), TITLE_RE, 1))


def page_domain(url) -> Column:
    """Host of the page as the structural set sees it (case kept)."""
    return netloc(with_http(_c(url)))


def external_link_ratio(html_lower, domain) -> Column:
    links = F.regexp_extract_all(_c(html_lower), F.lit(HREF_RE), 1)
    ext = F.size(F.filter(links, lambda l: l.startswith("http") & ~l.contains(domain)))
    return ext / F.greatest(F.size(links), F.lit(1))


def empty_link_ratio(html_lower, mode: str = "compat") -> Column:
    """Dead-link ratio of the structural set.

    ``compat``: every ``<a ... href=`` counts (the reference pattern has an
    empty alternative that always matches). ``intent``: only ``#``,
    ``javascript:void(0)`` and empty hrefs count.
    """
    hl = _c(html_lower)
    total = F.greatest(F.size(F.regexp_extract_all(hl, F.lit(HREF_RE), 1)), F.lit(1))
    pat = ANCHOR_HREF_RE if mode == "compat" else EMPTY_HREF_INTENT_RE
    return F.regexp_count(hl, F.lit(pat)) / total


def brand_title_norm(html) -> Column:
    t = F.lower(title_text(html))
    for w in TITLE_STOP_WORDS:
        t = F.replace(t, F.lit(w), F.lit(""))
    return F.regexp_replace(t, "[^a-z0-9]", "")


def brand_domain_norm(domain) -> Column:
    # the domain is not lower-cased first, so capitals vanish
    return F.regexp_replace(_c(domain), "[^a-z0-9]", "")


def brand_discrepancy_lev(html, domain) -> Column:
    """SQL form of the brand discrepancy: normalised edit distance between
    the cleaned title and the alphanumeric domain (0 when the title is empty
    or, longer than 3, contained in the domain)."""
    t = brand_title_norm(html)
    d = brand_domain_norm(domain)
    lev = F.levenshtein(t, d) / F.greatest(F.length(t), F.length(d))
    return (F.when(t == "", F.lit(0.0))
            .when((F.length(t) > 3) & d.contains(t), F.lit(0.0))
            .otherwise(lev))


def pattern_features(url, html) -> dict[str, Column]:
    """HTML columns 11-20 of the structural vector (pattern based)."""
    h = _c(html)
    hl = F.lower(h)
    dom = page_domain(url)
    n = F.length(h)
    return {
        "html_length": n,
        "html_num_tags": F.regexp_count(h, F.lit(TAG_RE)),
        "html_text_ratio": F.length(F.regexp_replace(h, TAG_RE, "")) / F.greatest(n, F.lit(1)),
        "html_script_count": count_substr(hl, "<script"),
        "html_external_link_ratio": external_link_ratio(hl, dom),
        "html_password_input_count": F.regexp_count(hl, F.lit(PASSWORD_RE)),
        "html_empty_link_ratio": empty_link_ratio(hl, "compat"),
        "html_input_to_p_ratio": (count_substr(hl, "<input") + count_substr(hl, "<button"))
        / F.greatest(count_substr(hl, "<p>"), F.lit(1)),
        "css_hidden_count": F.regexp_count(hl, F.lit(CSS_HIDDEN_RE)),
        "html_title_length": F.length(title_text(h)),
    }


# character references: those that stand for white space, and any
SPACE_ENTITY_RE = r"&(?:nbsp|ensp|emsp|thinsp);|&#(?:9|10|12|13|32|160);|&#[xX](?:9|[aAcCdD]|20|[aA]0);"
ENTITY_RE = r"&[a-zA-Z][a-zA-Z0-9]*;|&#[0-9]+;|&#[xX][0-9a-fA-F]+;"


def one_char_entities(text: Column) -> Column:
    """Text with each character reference as one character (a space or a mark):
    for lengths of decoded text."""
    return F.regexp_replace(F.regexp_replace(text, SPACE_ENTITY_RE, " "), ENTITY_RE, "*")


def decoded_letters(text) -> Column:
    """Lower-case text in which numeric references to ASCII letters are these letters."""
    def decode(t: Column) -> Column:
        for low in range(97, 123):
            t = F.regexp_replace(t, f"&#0*(?:{low - 32}|{low});|&#x0*(?:{low - 32:x}|{low:x});", chr(low))
        return t
    t = _c(text)
    return F.when(t.contains("&#"), decode(t)).otherwise(t)


def visible_text(html, limit: int | None = 2000) -> Column:
    """Lower-cased visible text: script/style removed, tags replaced by a
    space, character references decoded, only ASCII letters and whitespace kept,
    whitespace collapsed."""
    hl = F.lower(_c(html))
    t = F.regexp_replace(hl, r"(?s)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, TAG_RE, " ")
    t = decoded_letters(t)
    # any other reference is a space or a character that is no ASCII letter
    t = F.regexp_replace(F.regexp_replace(t, SPACE_ENTITY_RE, " "), ENTITY_RE, "")
    t = F.regexp_replace(t, r"[^a-zA-Z\t\n\x0B\f\r ]", "")
    t = strip_ws(F.regexp_replace(t, f"{WS}+", " "))
    return F.substring(t, 1, limit) if limit else t


def error_page_flag(html) -> Column:
    """Short page (< 2000 chars) that contains a server-error signature."""
    h = _c(html)
    pat = "(?i)(" + "|".join(ERROR_SIGNATURES) + ")"
    return (F.length(h) < 2000) & h.rlike(pat)


def title_link_list_text(url, html) -> Column:
    """URL parts plus tag-stripped text of title, anchor and list blocks."""
    u = _c(url)
    h = F.coalesce(_c(html), F.lit(""))
    u2 = with_http(u)
    sch = F.lower(F.regexp_extract(u2, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    query = F.regexp_extract(u2, r"\?([^#]*)", 1)
    from pagelab.functions.url import path as _path
    url_part = F.concat_ws(" ", sch, netloc(u2), _path(u2), query)
    url_part = F.replace(F.replace(url_part, F.lit("."), F.lit(" ")), F.lit("/"), F.lit(" "))

    def block(pattern):
        parts = F.array_join(F.regexp_extract_all(h, F.lit(pattern), 1), " ")
        return strip_ws(F.regexp_replace(parts, TAG_RE, " "))

    titles = block(r"(?is)<title[^>]*>(.*?)</title>")
    links = block(r"(?is)<a[^>]*>(.*?)</a>")
    lists = block(r"(?is)<(?:ul|ol|li)[^>]*>(.*?)</(?:ul|ol|li)>")
    html_part = F.when(F.length(h) > 5, F.concat_ws(" ", titles, links, lists)).otherwise(F.lit(""))
    return F.concat_ws(" ", url_part, html_part)
