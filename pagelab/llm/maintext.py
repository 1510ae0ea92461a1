"""Main text of a page by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative;
one linear scan finds the contiguous region of largest sum. Tag weights are
learned from labelled pages: pages whose author marks the article (<article> or
<main>) tell which tags stand inside and outside of it. The weight of a tag, by
its name and the nearest landmark around it, is its log odds of standing
outside, so paragraph marks inside an article cost next to nothing and the
marks of menus and footers cost much.

Class, id and role names that hold a word for something beside the article
(``SURE_MARK``, ``LIKELY_MARK``) have a weight by tag and name: the log odds of
standing outside the article on the labelled pages, with a prior that is strong
where the whole name says so and none where it is one word among others
('entry-header', 'related-work'). Inside an <article> only whole names count;
the page, headings and what holds an article are never beside it.

Inside the region, words of landmarks that are not article text (menus,
headers, footers, sidebars, notices, adverts, forms, comments) and of marks
with a weight of ``LEFT_OUT`` or below are left out; they carry no score either.
A form is one of them where its fields outweigh its words (``FIELD_WORDS`` each); a
form that wraps a page or an article is a plain element.
Scripts, styles, comments and the head are no words. The text of drawings and formulas (svg, math) is text; their tags carry no weight.

Text rules: character references are decoded, white space inside a block is
one space, ends are trimmed, blocks are joined by one newline in page order.

Defined cases: null or empty html, or none but boilerplate, gives the empty
text; cut-off tags and unclosed elements are taken as far as they go, but of raw
elements other than scripts and styles without an end tag only the tag is left out; with no
labelled page the weights fall back to ``PRIOR``; equal regions: the first wins.
"""

from __future__ import annotations

import functools
import html as htmllib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|iframe|noembed|noframes|title|textarea)(?=[\s/>])"
    r"""|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*>""", re.S | re.I)
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"""\s(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: The end tag of each element whose content is no markup, and the end of a tag.
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)", re.I)
            for x in "script style template iframe noembed noframes title textarea".split()}
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>|[^>]*(?:>|\Z)""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
                   "q s samp small span strike strong sub sup time tt u var wbr".split())
#: Drawings and formulas: ordinary elements, whose tags do not part the text around them or inside.
GRAPHIC = frozenset("svg math".split())
#: Pieces of text within these that stand apart from each other.
GRAPHIC_APART = frozenset("text mtd annotation annotation-xml foreignobject desc".split())
#: Tags that end an svg or math left open, as HTML does.
BREAKOUT = frozenset("article aside b blockquote body br center code dd div dl dt em embed footer h1 h2 h3 h4 h5 h6 head "
                     "header hr i img li main menu nav ol p pre ruby s section small span strong strike sub sup table tt "
                     "u ul var".split())
LANDMARK = frozenset("article main section nav aside header footer form head body dialog menu".split())
#: Words in a form that a visible field weighs up, and what such fields and a form's own words look like.
FIELD_WORDS = 25
_FIELD = re.compile(r"""<(?:select|textarea)(?=[\s/>])|<input(?=[\s/>])(?![^>]*\btype\s*=\s*["']?hidden)""", re.I)
_FORM_END = re.compile(r"</form(?=[\s/>])", re.I)
_FORM_OWN = re.compile(r"<(label|button|select|legend|script|style|textarea)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)", re.S | re.I)
_ARTICLE_PART = re.compile(r"<(?:article|main|h1)(?=[\s/>])", re.I)
ASIDE = frozenset("nav aside footer head dialog menu button select option noscript object audio video".split())
#: Words of class, id and role that name something beside the article wherever it stands.
SURE_MARK = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|"
    r"comments?|commentlist|replies|respond|disqus|share|sharing|related|recommended|newsletter|subscribe|signup|popup|"
    r"modal|pagination|pager|complementary|contentinfo")
#: Words that do so on many pages and name parts of the article on others.
LIKELY_MARK = re.compile(
    r"banner|notices?|alert|side|header|masthead|social|login|search|overlay|toolbar|dialog|form")
#: Words that may stand beside a mark in a name that says no more than the mark.
PLAIN = frozenset("site global top bottom main primary secondary wrap wrapper container inner outer bar box".split())
PLAIN_MORE = PLAIN | frozenset(
    "page area section block widget widgets list item items links link button buttons btn icon icons body content text "
    "title module panel unit slot group holder posts articles stories news author meta reply thread".split())
#: The article's own names, which leave a sure mark sure ('post-comments'), but for its footer.
HOST = frozenset("post article entry".split())
HEAD_MARK = frozenset(["header", "masthead"])
COMMENT_MARK = frozenset("comment comments commentlist replies respond disqus".split())
#: Never beside the article by their marks: the whole page and headings.
UNMARKED = frozenset("html body h1 h2 h3 h4 h5 h6 hgroup article main".split())
#: Names of a state of the layout, not of what stands in the element.
_STATE = frozenset("has no with without is not".split())
#: Openings beside the article that a mark is taken to have been seen with, against one inside.
MARK_PRIOR = {"sure": 20.0, "likely": 5.0, "part": 1.0}
MARK = "@"  # stands for the landmark in the keys of marks
LEFT_OUT = -1.0  # weight of a mark from which its words no longer score


#: Weights of tags outside any learned landmark.
PRIOR = {"p": -0.01, "h1": -0.01, "h2": -0.01, "h3": -0.01, "h4": -0.01, "h5": -0.01, "h6": -0.01, "br": -0.01,
         "blockquote": -0.01, "pre": -0.01, "article": -0.01, "main": -0.01, "ul": -1.0, "ol": -1.0, "li": -1.0,
         "div": -0.5, "section": -0.5, "table": -1.0, "tr": -0.5, "td": -0.5}
OTHER = -1.0
IN_ARTICLE = -0.01  # of a tag that no labelled page shows inside an article


def _marks(tag: str) -> str:
    return " ".join("".join(m) for m in _MARKS.findall(tag))


@functools.lru_cache(1 << 16)
def _strength(mark: str) -> str | None:
    """How surely a name means something beside the article: 'sure' and 'likely' if the
    whole name says so, 'part' if it has such a word among others, None if it has none."""
    parts = [x for x in re.split(r"[-_\d]+", mark) if x]
    sure = [x for x in parts if SURE_MARK.fullmatch(x)]
    likely = [x for x in parts if LIKELY_MARK.fullmatch(x)]
    if not (sure or likely) or parts[0] in _STATE:
        return None
    other = set(parts) - set(sure) - set(likely)
    if not sure:
        return "likely" if other <= PLAIN else "part"
    return "sure" if other <= (PLAIN_MORE if "footer" in sure else PLAIN_MORE | HOST) else "part"


def mark_weight(mark: str, outside: int = 0, inside: int = 0) -> float:
    """Weight of a name seen so often outside and inside of articles."""
    return -max(0.0, math.log((outside + MARK_PRIOR[_strength(mark)]) / (inside + 1.0)))


def _beside(name: str, mark: str, inside: bool, weights: dict[str, float]) -> bool:
    """Whether an element of this name is beside the article by its weight. What an
    author puts into an article is part of it unless its whole name says otherwise."""
    strength = _strength(mark)
    if strength is None or (inside and (strength == "part" or HEAD_MARK & set(re.split(r"[-_\d]+", mark)))):
        return False
    w = weights.get(f"{MARK} {name} {mark}")
    return (mark_weight(mark) if w is None else w) <= LEFT_OUT


def _is_wrapper(page: str, at: int) -> bool:
    """Whether the form whose content begins at ``at`` holds more words than its fields weigh up."""
    end = _FORM_END.search(page, at)
    inside = page[at:end.start() if end else len(page)]
    fields = len(_FIELD.findall(inside))
    if not fields or _ARTICLE_PART.search(inside):
        return True
    return len(_TAG.sub(" ", _FORM_OWN.sub(" ", inside)).split()) > FIELD_WORDS * fields


def tokens(page: str, weights: dict[str, float] | None = None,
           seen: Counter | None = None) -> Iterator[tuple[str, str, str, bool, bool]]:
    """(kind, value, landmark, aside, inside) of each token: kind 'w' for text
    between tags, else the tag's name; value is the text, or '/' for an end tag.
    ``landmark`` names the nearest landmark, ``aside`` tells that the token lies
    in something beside the article, ``inside`` that it lies in <article> or <main>.
    ``seen`` counts (``MARK``, tag and name, part of the article) of the marked elements."""
    weights = weights or {}
    # frames: (name, landmark, aside, inside, comment, keys of its marks in seen)
    stack: list[tuple[str, str, bool, bool, bool, list]] = [("", "", False, False, False, [])]
    open_names: Counter = Counter()  # of the stack, so that an end tag without a start looks no further

    def pop(to: int) -> None:
        for frame in stack[to:]:
            open_names[frame[0]] -= 1
        del stack[to:]

    at = form_end = 0
    unended: set[str] = set()  # raw elements without an end tag in the rest of the page
    while m := _TAG.search(page, at):
        if m.start() > at:
            yield ("w", page[at:m.start()], *stack[-1][1:4])
        at = m.end()
        if m.group("raw"):
            name = m.group("raw").lower()
            yield (name, "", stack[-1][1], True, stack[-1][3])
            end = None if name in unended else _RAW_END[name].search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            else:  # only the tag itself is left out
                unended.add(name)
                at = _TAG_END.match(page, at).end()
            continue
        tag = m.group()
        name = _NAME.match(tag)
        if name is None:
            continue
        name = name.group(1).lower()
        if tag[1] == "/":
            if open_names[name] > 0:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                yield (name, "/", *stack[i][1:4])
                pop(i)
            else:
                yield (name, "/", *stack[-1][1:4])
            continue
        if stack[-1][1] in GRAPHIC and name in BREAKOUT and not open_names["foreignobject"]:
            while stack[-1][1] in GRAPHIC:
                pop(len(stack) - 1)
        if name == "body" or (name in ("article", "main") and not stack[-1][3] and not stack[-1][4]):
            # an article ends whatever was left open beside it, but those of comments and teasers do not
            if seen is not None and name != "body":
                for frame in stack:  # what holds an article is a wrapper and not beside it
                    for key in frame[5]:
                        seen[key] -= 1
                        seen[(*key[:2], True)] += 1
                    frame[5].clear()
            while len(stack) > 1 and stack[-1][2]:
                pop(len(stack) - 1)
        _, landmark, aside, inside, comment, _ = stack[-1]
        marks = _marks(tag).lower().split()
        # an article within another, or within comments, may be beside it
        named = [] if name in INLINE or name in GRAPHIC or landmark in GRAPHIC or (name in UNMARKED and not (name == "article" and (inside or comment))) else [
            _DIGITS.sub("0", x) for x in marks]
        found = [x for x in named if _beside(name, x, inside, weights)]
        keys = []
        if seen is not None and not aside:
            for x in named:
                if _strength(x):
                    # a name that is sure says so inside an article too
                    keys.append((MARK, f"{name} {x}", inside and _strength(x) != "sure"))
            for key in keys:
                seen[key] += 1
            keys = [k for k in keys if not k[2]]
        form = False
        if name == "form" and at >= form_end:  # forms do not nest: each stretch is looked at once
            form = not _is_wrapper(page, at)
            ended = _FORM_END.search(page, at)
            form_end = ended.end() if ended else len(page)
        if name in ASIDE or form or found:
            aside, landmark = True, f"{name}.{marks[0]}" if marks else name
            comment = comment or any(COMMENT_MARK & set(re.split(r"[-_\d]+", x)) for x in found)
        elif name == "header" and not inside:
            aside, landmark = True, name
        elif (name in LANDMARK and name != "form") or name in GRAPHIC:
            landmark = name
        if name in ("article", "main") and not aside:
            inside = True
        if name in VOID or tag.endswith("/>"):
            yield (name, "", landmark, aside, inside)
        else:
            stack.append((name, landmark, aside, inside, comment, keys))
            open_names[name] += 1
            yield (name, "", landmark, aside, inside)
    if at < len(page):
        yield ("w", page[at:], *stack[-1][1:4])


def learn_counts(page: str) -> Counter:
    """(landmark, tag, inside the article) -> tags, and the same of (``MARK``, tag and name,
    part of the article), of one labelled page."""
    out: Counter = Counter()
    seen: Counter = Counter()
    for kind, _, landmark, aside, inside in tokens(page, seen=seen):
        if kind != "w":
            out[landmark, kind, inside and not aside] += 1
    out.update({k: n for k, n in seen.items() if n})
    return out


def learn(pages: DataFrame, max_fit_pages: int = 2_000, smoothing: float = 0.5) -> dict[str, float]:
    """'landmark tag' and 'MARK tag name' -> weight, from at most ``max_fit_pages`` labelled pages
    (those with <article> or <main>; the smallest hashes of page_id and url)."""
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]")).select(
        F.xxhash64("page_id", "url").alias("_h"), "html")
    # hashes alone are ranked; the pages of the chosen ones (at most max_fit_pages) follow
    first = marked.select("_h").orderBy("_h").limit(max_fit_pages).distinct()
    chosen = marked.join(F.broadcast(first), "_h", "left_semi").select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                total.update(learn_counts(x.as_py()))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{k[0]} {k[1]}" for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()),
             pa.array([total[k] for k in keys], pa.int64())], names=["tag", "inside", "n"])

    found = (chosen.mapInArrow(count, "tag string, inside boolean, n bigint")
             .groupBy("tag").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"),
                                 F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("o"))
             .collect())  # one row per kind of tag seen on the labelled pages
    return {r["tag"]: mark_weight(r["tag"].rsplit(" ", 1)[1], r["o"], r["i"]) if r["tag"].startswith(f"{MARK} ")
            else -0.01 - max(0.0, math.log((r["o"] + smoothing) / (r["i"] + smoothing))) for r in found}


def scores(rows: list, weights: dict[str, float]) -> list[float]:
    """Words of each piece of text, weight of each tag; 0 for what is left out and may stand in a region."""
    out = []
    for kind, value, landmark, aside, inside in rows:
        if kind == "w":
            out.append(0.0 if aside else float(len(value.split())))
        elif not (aside and inside) and landmark not in GRAPHIC:  # what is left out of a marked article does not part it
            w = weights.get(f"{landmark} {kind}")
            out.append((IN_ARTICLE if inside else PRIOR.get(kind, OTHER)) if w is None else w)
        else:
            out.append(0.0)
    return out


def best_region(score: list[float]) -> tuple[int, int]:
    """(begin, end) of the contiguous stretch of largest positive sum, in one scan; the first of equals."""
    best, begin, end = 0.0, 0, 0
    run, start = 0.0, 0
    for i, s in enumerate(score):
        run += s
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, begin, end = run, start, i + 1
    return begin, end


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    if not page:
        return ""
    rows = list(tokens(page, weights))
    begin, end = best_region(scores(rows, weights))
    blocks: list[str] = []
    parts: list[str] = []

    def close():
        text = " ".join(htmllib.unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    for kind, value, landmark, aside, _ in rows[begin:end]:
        if kind == "w":
            if not aside:
                parts.append(value)
        elif landmark in GRAPHIC:
            if kind in GRAPHIC_APART:
                parts.append(" ")
        elif kind not in INLINE:
            close()
        elif kind == "br":
            parts.append(" ")
    close()
    return "\n".join(blocks)


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``pages`` with ``text``: the main text of the whole html of each row."""
    @F.arrow_udf("string")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([main_text(x.as_py(), weights) for x in part], pa.string())
    return pages.withColumn("text", of(F.col("html")))
