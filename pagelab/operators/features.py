"""Per-page feature tables (narrow projections: no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelab.functions import dom, html as H, url as U

BASE_28 = [
    "url_length", "url_num_dots", "is_https", "url_num_special_chars", "url_digit_ratio",
    "url_num_subdomains", "url_entropy", "url_path_depth", "url_has_login", "url_hyphen_domain",
    "html_length", "html_num_tags", "html_text_ratio", "html_script_count",
    "html_external_link_ratio", "html_password_input_count",
    "html_empty_link_ratio", "html_input_to_p_ratio", "css_hidden_count",
    "html_title_length", "brand_discrepancy", "dom_depth", "tag_diversity",
    "external_resource_ratio", "foreign_form_action",
    "html_js_ratio", "body_tag_count", "iframe_count",
]
TREE_7 = BASE_28[21:]
URL_10 = BASE_28[:10]


def url_features(df: DataFrame, url: str = "url", keep=("page_id",), which: str = "structural") -> DataFrame:
    fn = {"structural": U.structural_url_features, "lexical": U.lexical_url_features,
          "manual": U.manual_url_features, "eda": U.eda_url_features}[which]
    cols = [F.col(k) for k in keep if k in df.columns]
    return df.select(*cols, *[c.alias(n) for n, c in fn(url).items()])


def tree_features(df: DataFrame, keep=("page_id",)) -> DataFrame:
    """Columns 22-28: the stack fold over tag events; pages with no element
    get zeros (D8 zero imputation)."""
    keep = [k for k in keep if k in df.columns]
    t = dom.with_events(df.select(*keep, "html", H.page_domain("url").alias("domain")))
    exprs = dom.tree_features_sql("html", "domain")
    has_el = F.exists("ev", lambda e: ~e["closing"])
    return t.select(*keep, *[F.when(has_el, F.expr(e)).otherwise(F.lit(0)).cast(
        "double" if n in ("external_resource_ratio", "html_js_ratio") else "int").alias(n)
        for n, e in exprs.items()])


def structural_base(df: DataFrame, keep=("page_id",), brand: str = "lev") -> DataFrame:
    """The 28 base structural columns per page, in order.

    ``brand='lev'`` uses the SQL edit-distance form of the brand discrepancy;
    ``brand='difflib'`` uses the sequence-matcher ratio (vectorised pandas UDF).
    """
    keep = [k for k in keep if k in df.columns]
    h = F.coalesce(F.col("html"), F.lit(""))
    dom_col = H.page_domain("url")
    t = dom.with_events(df.select(*keep, "url", h.alias("html"), dom_col.alias("domain")))
    url_cols = U.structural_url_features("url")
    pat_cols = H.pattern_features("url", "html")
    if brand == "difflib":
        from pagelab.functions.udfs import brand_discrepancy_difflib
        bd = brand_discrepancy_difflib(H.brand_title_norm("html"), H.brand_domain_norm("domain"))
    else:
        bd = H.brand_discrepancy_lev("html", "domain")
    has_el = F.exists("ev", lambda e: ~e["closing"])
    tree = {n: F.when(has_el, F.expr(e)).otherwise(F.lit(0))
            for n, e in dom.tree_features_sql("html", "domain").items()}
    allc = {**url_cols, **pat_cols, "brand_discrepancy": bd, **tree}
    return t.select(*keep, *[allc[n].cast("double").alias(n) for n in BASE_28])
