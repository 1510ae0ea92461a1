"""M1: featuriser registry: name -> processor with ``fit(df) -> model`` and
``model.transform(df) -> DataFrame``. Unknown names raise ``ValueError``.

All processors take a page table with ``page_id``, ``url`` and (where
needed) ``html``; fitted state is small (vocabularies bounded by their size
parameters, one-row statistics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelab.functions import url as U
from pagelab.operators import scale as SC, text as T


class _Fitted:
    def __init__(self, fn):
        self._fn = fn

    def transform(self, df: DataFrame) -> DataFrame:
        return self._fn(df)


class UrlProcessor:
    """Eleven lexical URL columns, z-scored with statistics of the fit rows."""

    def __init__(self, config: dict | None = None):
        self.config = config or {}

    def fit(self, df: DataFrame):
        cols = list(U.lexical_url_features("url"))
        f = df.select("page_id", *[c.alias(n) for n, c in U.lexical_url_features("url").items()])
        st = SC.zscore_fit(f, cols).first()  # one row

        def apply(d):
            g = d.select("page_id", *[c.alias(n) for n, c in U.lexical_url_features("url").items()])
            return g.select("page_id", *[((F.col(c) - st[f"{c}__mean"]) / st[f"{c}__sd"]).alias(c) for c in cols])
        return _Fitted(apply)


class ManualProcessor:
    """Sixteen hand-written URL counts padded to ``n_features`` (no fitting)."""

    def __init__(self, config: dict | None = None):
        self.n = (config or {}).get("n_features", 48)

    def fit(self, df: DataFrame):
        return _Fitted(lambda d: d.select("page_id", U.manual_vector("url", self.n).alias("features")))


class MultimodalProcessor:
    """URL character ids (180) and HTML token ids (2000, vocabulary fitted)."""

    def __init__(self, config: dict | None = None):
        c = config or {}
        self.url_len, self.html_len, self.vocab = c.get("url_max_length", 180), c.get("html_max_length", 2000), c.get("html_vocab_size", 50000)

    def fit(self, df: DataFrame):
        toks = df.select("page_id", T.hybrid_tokens("html").alias("t"))
        vocab = T.frequency_vocab(toks, "t", self.vocab).cache()  # bounded by html_vocab_size

        def apply(d):
            t = d.select("page_id", "url", T.hybrid_tokens("html").alias("t"))
            ids = T.ids_from_vocab(t, "page_id", "t", vocab, self.html_len, out="html_ids")
            return t.select("page_id", T.url_char_ids("url", self.url_len).alias("url_ids")).join(ids, "page_id")
        return _Fitted(apply)


class SequentialProcessor:
    """Frequency-ranked URL character ids (vocabulary 128, 256 wide)."""

    def __init__(self, config: dict | None = None):
        c = config or {}
        self.length, self.num_words = c.get("max_seq_length", 256), c.get("vocab_size", 128)

    def fit(self, df: DataFrame):
        vocab = T.char_frequency_vocab(df, "url", self.num_words)
        return _Fitted(lambda d: T.char_frequency_ids(d, vocab, "page_id", "url", self.length))


class RnnGruProcessor:
    """URL sub-word ids (vocabulary incl. pad and unknown, fixed width)."""

    def __init__(self, config: dict | None = None):
        c = config or {}
        self.length, self.size = c.get("max_seq_length", 200), c.get("vocab_size", 100)

    def fit(self, df: DataFrame):
        toks = df.select("page_id", T.url_subword_tokens("url").alias("t"))
        vocab = T.frequency_vocab(toks, "t", self.size)

        def apply(d):
            t = d.select("page_id", T.url_subword_tokens("url").alias("t"))
            return T.ids_from_vocab(t, "page_id", "t", vocab, self.length)
        return _Fitted(apply)


class TfidfVaeProcessor:
    """Character 1-4-gram (word-bounded) TF-IDF of URL parts + title, anchor
    and list text, long form (page_id, term, idx, weight)."""

    def __init__(self, config: dict | None = None):
        self.k = (config or {}).get("max_features", 5000)

    def fit(self, df: DataFrame):
        from pagelab.functions.html import title_link_list_text

        def docs(d):
            return d.select("page_id", T.char_wb_ngrams(title_link_list_text("url", "html")).alias("g"))
        vocab = T.tfidf_fit(docs(df), "page_id", "g", self.k)
        return _Fitted(lambda d: T.tfidf_transform(docs(d), "page_id", "g", vocab))


class StructuralProcessor:
    """The 163-column structural vector."""

    def __init__(self, config: dict | None = None):
        self.config = config or {}

    def fit(self, df: DataFrame):
        from pagelab.operators.vector import StructuralFeaturizer
        return StructuralFeaturizer().fit(df)


PROCESSORS = {
    "structural": StructuralProcessor,
    "url": UrlProcessor,
    "manual": ManualProcessor,
    "multimodal": MultimodalProcessor,
    "sequential": SequentialProcessor,
    "rnn_gru": RnnGruProcessor,
    "tfidf_vae": TfidfVaeProcessor,
}


def get_processor(name: str, config: dict | None = None):
    if name not in PROCESSORS:
        raise ValueError(f"no processor is registered as {name!r}; names: {', '.join(sorted(PROCESSORS))}")
    return PROCESSORS[name](config)
