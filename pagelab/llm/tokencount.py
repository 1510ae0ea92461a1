"""Token counts of a unigram tokenizer without making tokens.

An Aho-Corasick automaton of the vocabulary enumerates all pieces that end at
each character; dynamic programming carries the best score and the number of
pieces of the best path. Tie rules are the tokenizer's: paths are compared by
strict "greater", candidates in order of their start, so the piece that starts
first wins; a character that is no piece of its own is an unknown of the lowest
score less ten; unknowns in a row are one token, or a token per UTF-8 byte
where the vocabulary has byte pieces. Spaces become U+2581, a text that does not
begin with one gets one, and pieces stay within words (runs that begin at that
mark), so each distinct word is solved once per worker. ``cut=False`` is the rule of
tokenizers that do not cut at marks: pieces with a mark further in match as well (runs
of spaces), and the dynamic programming runs over the whole text in one go.

The vocabulary (a SentencePiece file, or a tokenizers JSON of kind Unigram) is
a path parameter; the file of pieces and scores is read, never trained or
copied. Pieces of other kinds (control, unknown, bytes) match no text.

Defined cases: null and empty texts have 0 tokens; repeated rows are counted
each; extra columns pass through.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]  # those that match text
    byte_fallback: bool


def load(path: str, max_pieces: int = 2_000_000) -> Vocabulary:
    """Pieces and scores of a tokenizer file (its size is bounded by ``max_pieces``)."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("type") != "Unigram":
            raise ValueError("a tokenizer of kind Unigram is needed")
        rows = [(p, float(s)) for i, (p, s) in enumerate(model["vocab"]) if i != model.get("unk_id")]
        fallback = bool(model.get("byte_fallback"))
        rows = [r for r in rows if not (fallback and len(r[0]) == 6 and r[0].startswith("<0x"))]
    else:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        fallback = any(sp.is_byte(i) for i in n)
        rows = [(sp.id_to_piece(i), sp.get_score(i)) for i in n
                if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    if len(rows) > max_pieces:
        raise ValueError(f"{len(rows)} pieces, over max_pieces")
    return Vocabulary(tuple(rows), fallback)


class Counter:
    """Counts of words under one vocabulary; at most ``hold`` words stay known. Without ``cut`` a
    text is one word, and none stays known."""

    def __init__(self, vocabulary: Vocabulary, hold: int = 500_000, cut: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.empty = not vocabulary.pieces
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = vocabulary.byte_fallback
        self.hold, self.known, self.cut = hold, {}, cut

    def word(self, word: str) -> int:
        """Number of tokens on the best path through ``word``."""
        score, count, unknown = [0.0], [0], [False]  # of the best path to each place
        found = iter(()) if self.empty else self.automaton.iter(word)  # by end, the longest first
        match = next(found, None)
        for end, char in enumerate(word, 1):
            best, n, odd, single = float("-inf"), 0, False, False
            while match is not None and match[0] == end - 1:
                size, s = match[1]
                if score[end - size] + s > best:
                    best, n = score[end - size] + s, count[end - size] + 1
                single |= size == 1
                match = next(found, None)
            if not single and score[-1] + self.unknown > best:
                best, odd = score[-1] + self.unknown, True
                if self.bytes:
                    n = count[-1] + len(char.encode("utf-8", "surrogatepass"))
                else:
                    n = count[-1] + (not unknown[-1])
            score.append(best)
            count.append(n)
            unknown.append(odd)
        return count[-1]

    def text(self, text: str | None) -> int:
        """Number of tokens of a whole text."""
        if not text:
            return 0
        if not self.cut:
            return self.word(marked(text))
        parts = words(text)
        known = self.known
        new = [w for w in set(parts) if w not in known]
        if len(known) + len(new) > self.hold:
            known.clear()
            new = set(parts)
        for w in new:
            known[w] = self.word(w)
        return sum(map(known.__getitem__, parts))


def marked(text: str) -> str:
    """The text with marks for spaces, and one at its beginning."""
    text = text.replace(" ", MARK)
    return text if text.startswith(MARK) else MARK + text


def words(text: str) -> list[str]:
    """The text cut before every mark, each part with its mark."""
    return [MARK + w for w in marked(text)[1:].split(MARK)]


_COUNTERS: dict[str, Counter] = {}  # of this worker, so that words stay known between tasks


def with_counts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "n_tokens",
                cut: bool = True) -> DataFrame:
    """``docs`` with the number of tokens of each whole text; ``cut`` as above. The
    vocabulary is broadcast; its size is bounded where it is loaded."""
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    @F.arrow_udf("bigint")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _COUNTERS.get(key)
        if counter is None:
            _COUNTERS.clear()  # one vocabulary at a time
            counter = _COUNTERS[key] = Counter(shared.value, cut=cut)
        for part in parts:
            yield pa.array([counter.text(x.as_py()) for x in part], pa.int64())

    return docs.withColumn(out, of(F.col(f"`{text}`")))
