"""URL features as Spark column expressions.

Every function takes a string Column and returns a Column; nothing leaves the
JVM, so whole-stage codegen covers the projections that use them.

The URL is split with regular expressions instead of ``parse_url``: the
latter drops port and userinfo from the host and returns NULL on illegal
URLs, while the features below count characters of the raw network location.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# suspicious top-level domains (lexical URL set)
SUSPICIOUS_TLDS = [
    ".xyz", ".top", ".pw", ".cc", ".tk", ".ml", ".ga", ".cf", ".gq", ".icu",
    ".vip", ".work", ".click", ".link", ".club", ".online", ".site", ".biz",
]
# brands looked for outside the registered domain (lexical URL set)
TOP_BRANDS = [
    "paypal", "microsoft", "apple", "amazon", "facebook", "chase",
    "netflix", "google", "wellsfargo", "bankofamerica", "whatsapp",
    "instagram", "linkedin", "dhl", "fedex", "ups", "adobe", "dropbox",
    "yahoo", "binance", "coinbase",
]
# keywords counted in the lower-cased URL (lexical URL set)
PHISH_KEYWORDS = [
    "login", "secure", "verify", "account", "auth", "update",
    "support", "service", "webscr", "confirm", "billing", "recover",
]
# six characters summed by the lexical special-character count
LEXICAL_SPECIAL_CHARS = ["-", "@", "?", "=", "%", "_"]
# brands of the exploratory URL table
EDA_BRANDS = ["paypal", "amazon", "microsoft", "google", "netflix", "apple"]
# ---------------------------------------------------------------------------

SCHEME_RE = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://"
NETLOC_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
PATH_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
NOSCHEME_PATH_RE = r"^([^?#]*)"
IPV4_RE = r"([0-9]{1,3}\.){3}[0-9]{1,3}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and hand it to ``fn`` as a lambda variable.

    Expressions referenced inside higher-order-function lambdas can be
    inlined by the optimizer and re-evaluated per element; binding through a
    one-element ``transform`` guarantees one evaluation per row."""
    return F.element_at(F.transform(F.array(expr), fn), 1)


def with_http(url) -> Column:
    """Prefix ``http://`` when the URL does not start with ``http``."""
    u = _c(url)
    return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("http://"), u))


def scheme(url) -> Column:
    """Lower-cased scheme of an absolute URL, '' when there is none."""
    return F.lower(F.regexp_extract(_c(url), SCHEME_RE, 1))


def netloc(url) -> Column:
    """Network location (host with port and userinfo), '' when no scheme."""
    return F.regexp_extract(_c(url), NETLOC_RE, 1)


def path(url) -> Column:
    """Path of an absolute URL; for a URL without ``scheme://`` the part
    before ``?``/``#`` is the path."""
    u = _c(url)
    return F.when(u.rlike(SCHEME_RE), F.regexp_extract(u, PATH_RE, 1)) \
        .otherwise(F.regexp_extract(u, NOSCHEME_PATH_RE, 1))


def count_char(s, ch: str) -> Column:
    """Occurrences of a literal substring (non-overlapping)."""
    s = _c(s)
    return ((F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))) / F.lit(len(ch))).cast("int")


def count_regex(s, pattern: str) -> Column:
    """Characters matched by a one-character class pattern."""
    s = _c(s)
    return (F.length(s) - F.length(F.regexp_replace(s, pattern, ""))).cast("int")


def subdomain_count(host) -> Column:
    """labels - 2, floored at 0."""
    return F.greatest(F.size(F.split(_c(host), r"\.")) - 2, F.lit(0))


def shannon_entropy(s) -> Column:
    """Shannon entropy in bits of the characters of a string; 0 for ''.

    H = log2(n) - (1/n) * sum_c cnt_c * log2(cnt_c), evaluated with array
    higher-order functions inside the row (no explode, no shuffle).
    """
    s = _c(s)

    def from_chars(chars):
        n = F.size(chars).cast("double")

        def per_char(acc, ch):
            cnt = F.size(F.filter(chars, lambda x: x == ch)).cast("double")
            return acc + cnt * F.log2(cnt)
        summed = F.aggregate(F.array_distinct(chars), F.lit(0.0), per_char)
        return F.when(n == 0, F.lit(0.0)).otherwise(F.log2(n) - summed / n)
    return bind(F.filter(F.split(F.coalesce(s, F.lit("")), ""), lambda c: c != ""), from_chars)


# --------------------------------------------------------------- structural set
def structural_url_features(url) -> dict[str, Column]:
    """The ten URL columns of the structural vector, in order."""
    u = _c(url)
    u2 = with_http(u)
    host = netloc(u2)
    p = path(u2)
    stripped = F.regexp_replace(p, r"^/+|/+$", "")
    return {
        "url_length": F.length(u),
        "url_num_dots": count_char(host, "."),
        "is_https": (scheme(u2) == "https").cast("int"),
        "url_num_special_chars": F.length(F.regexp_replace(u, r"[\p{L}\p{N}]", "")),
        "url_digit_ratio": count_regex(u, r"\p{Nd}") / F.greatest(F.length(u), F.lit(1)),
        "url_num_subdomains": subdomain_count(host),
        "url_entropy": shannon_entropy(u),
        "url_path_depth": F.when(p == "", F.lit(0)).otherwise(F.size(F.split(stripped, "/"))),
        "url_has_login": F.lower(u).contains("login").cast("int"),
        "url_hyphen_domain": host.contains("-").cast("int"),
    }


# ------------------------------------------------------------------ lexical set
def lexical_url_features(url) -> dict[str, Column]:
    """The eleven lexical URL columns, in order."""
    u = _c(url)
    ul = with_http(F.lower(u))
    dom = netloc(ul)
    p = path(ul)
    labels = F.split(dom, r"\.")
    tld = F.when(dom.contains("."), F.concat(F.lit("."), F.element_at(labels, -1))).otherwise(F.lit(""))
    root = F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(dom)
    brands = F.array(*[F.lit(b) for b in TOP_BRANDS])
    special = sum((count_char(u, c) for c in LEXICAL_SPECIAL_CHARS), F.lit(0))
    keywords = sum((count_char(ul, k) for k in PHISH_KEYWORDS), F.lit(0))
    return {
        "url_length": F.length(u),
        "url_num_dots": count_char(u, "."),
        "url_num_special_chars": special.cast("int"),
        "url_digit_ratio": count_regex(u, r"\p{Nd}") / F.greatest(F.length(u), F.lit(1)),
        "url_num_subdomains": subdomain_count(dom),
        "url_path_depth": count_char(p, "/"),
        "url_hyphen_domain": dom.contains("-").cast("int"),
        "domain_entropy": shannon_entropy(dom),
        "tld_suspiciousness": tld.isin(SUSPICIOUS_TLDS).cast("int"),
        "brand_impersonation": F.exists(brands, lambda b: ul.contains(b) & ~root.contains(b)).cast("int"),
        "keyword_stuffing_score": keywords.cast("int"),
    }


# ------------------------------------------------------------------- manual set
def manual_url_features(url) -> dict[str, Column]:
    """The sixteen hand-written URL columns (no ``http://`` prefixing)."""
    u = _c(url)
    host = netloc(u)
    p = path(u)
    rev_pos = F.instr(F.reverse(u), "//")
    last_dslash = F.when(rev_pos == 0, F.lit(-1)).otherwise(F.length(u) - rev_pos - 1)
    return {
        "m_length": F.length(u),
        "m_dots": count_char(u, "."),
        "m_hyphens": count_char(u, "-"),
        "m_underscores": count_char(u, "_"),
        "m_slashes": count_char(u, "/"),
        "m_questions": count_char(u, "?"),
        "m_equals": count_char(u, "="),
        "m_ampersands": count_char(u, "&"),
        "m_digits": count_regex(u, r"\p{Nd}"),
        "m_letters": count_regex(u, r"\p{L}"),
        "m_is_ip": u.rlike(IPV4_RE).cast("int"),
        "m_has_at": u.contains("@").cast("int"),
        "m_double_slash": (last_dslash > 7).cast("int"),
        "m_depth": F.size(F.filter(F.split(p, "/"), lambda s: s != "")),
        "m_https": (scheme(u) == "https").cast("int"),
        "m_subdomains": subdomain_count(host),
    }


def manual_vector(url, n_features: int = 48) -> Column:
    """The sixteen manual features zero-padded (or cut) to ``n_features``."""
    feats = [c.cast("double") for c in manual_url_features(url).values()]
    arr = F.array(*feats)
    if n_features > len(feats):
        arr = F.concat(arr, F.array_repeat(F.lit(0.0), n_features - len(feats)))
    return F.slice(arr, 1, n_features)


# ---------------------------------------------------------------------- EDA set
def eda_url_features(url) -> dict[str, Column]:
    """Exploratory URL table over the lower-cased URL: length, depth, dots,
    digit ratio, IP flag, brand flag."""
    ul = F.lower(_c(url))
    brands = F.array(*[F.lit(b) for b in EDA_BRANDS])
    n = F.length(ul)
    return {
        "eda_url_length": n,
        "eda_url_depth": count_char(ul, "/"),
        "eda_num_dots": count_char(ul, "."),
        "eda_digit_ratio": F.when(n > 0, count_regex(ul, r"\p{Nd}") / n).otherwise(F.lit(0.0)),
        "eda_has_ip": ul.rlike(IPV4_RE).cast("int"),
        "eda_brand_in_url": F.exists(brands, lambda b: ul.contains(b)).cast("int"),
    }
