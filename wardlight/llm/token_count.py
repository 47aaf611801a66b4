"""Token counts of a unigram vocabulary: Aho-Corasick matches, then a Viterbi pass that carries score and count.

The count is that of ``tokenizers.models.Unigram`` (with byte fallback) behind a
``Metaspace`` split, without making tokens: words are split at white space and
prefixed with the word mark; an automaton lists all vocabulary pieces in a word;
the pass goes through the places of a word from left to right and keeps, for each,
the best score and the number of pieces on the way there.

Tie rules, as in that library: a way replaces another of the same end only if its
score is greater, and ways are tried in the order of their last piece's start, so
the earlier start (the longer last piece) wins a tie.  A character that is no
piece of its own may also be passed as unknown, at the least score minus 10, tried
after the pieces of the same start.  Neighbouring unknowns are one; they count one
token per UTF-8 byte.

Words are counted once while they are kept, which long words are not.  The
vocabulary may be any list of pieces with scores; the query reads a byte-pair model's
pieces as one (none of the given files is a unigram model), so its counts are the
library's for that vocabulary as a unigram one, and not the model's own.  Nulls and edges: a null or empty text
has no tokens; repeated rows are answered one by one; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from wardlight.llm.common import plain, sliced

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the library
KEPT = 500_000  # words kept, of
KEPT_LENGTH = 64  # characters at most


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, in the order of their ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counted:
    """Counts the tokens of words over one vocabulary, given as (piece, score) with the unknown piece first."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.known: dict[str, int] = {}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in self.names for b in range(256))
        self.alone = {p for p, _ in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def word(self, word: str) -> int:
        """Tokens of one marked word.

        If every character is a piece there are no unknowns, and matches, which come
        by their end and longest first, are in the order that the tie rule asks for.
        """
        n = len(word)
        if self.alone.issuperset(word):
            best, steps = [0.0] + [-np.inf] * n, [0] * (n + 1)
            for last, (length, gain) in self.automaton.iter(word):
                begin = last + 1 - length
                reached = best[begin] + gain
                if reached > best[last + 1]:
                    best[last + 1], steps[last + 1] = reached, steps[begin] + 1
            return steps[n]
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, (length, score) in self.automaton.iter(word):
            matches[last - length + 1].append((last + 1, score))
        score = [0.0] + [None] * n
        count = [0] * (n + 1)
        run = [-1] * (n + 1)  # where the unknown stretch that ends here began
        for i in range(n):
            here, alone = score[i], False
            for end, gain in sorted(matches[i]):
                alone = alone or end == i + 1
                if score[end] is None or here + gain > score[end]:
                    score[end], count[end], run[end] = here + gain, count[i] + 1, -1
            if not alone and (score[i + 1] is None or here + self.unknown > score[i + 1]):
                cost = len(word[i].encode()) if self.bytes else int(run[i] < 0)
                score[i + 1], count[i + 1], run[i + 1] = here + self.unknown, count[i] + cost, i if run[i] < 0 else run[i]
        return count[n]

    def text(self, text: str) -> int:
        """Tokens of a whole text."""
        total = 0
        for word, times in Counter(marked_words(text)).items():
            found = self.known.get(word)
            if found is None:
                found = self.word(word)
                if len(word) <= KEPT_LENGTH:
                    if len(self.known) >= KEPT:
                        self.known.clear()
                    self.known[word] = found
            total += found * times
        return total


def marked_words(text: str) -> list[str]:
    """Words as the library splits them: every space becomes a mark, and a mark begins a word."""
    if not text:
        return []
    text = text.replace(" ", MARK)
    if not text.startswith(MARK):
        text = MARK + text
    return [MARK + w for w in text.split(MARK)[1:]]


@lru_cache(maxsize=2)
def counted(path: str) -> Counted:
    return Counted(vocabulary(path))


def token_count(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``n_words`` of every row's whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_words", pa.int64())])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counted(path)
        for part in sliced(parts):
            texts = part.column(1).to_pylist()
            yield pa.record_batch([
                part.column(0), pa.array(np.array([own.text(t) for t in texts], np.int64)),
                pa.array(np.array([len(marked_words(t)) for t in texts], np.int64)),
            ], schema=schema)

    return plain(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_tokens long, n_words long")
