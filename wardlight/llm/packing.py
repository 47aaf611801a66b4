"""Harmonic packing: token sequences cut and packed by reciprocal-capacity classes.

Every document (its ids, then the end id) is cut into whole sequences of
``capacity`` tokens, then into halves of it by the binary digits of the rest, and
what is left below ``SHORT`` tokens stays one piece.  A piece of n tokens belongs
to class j = capacity // n; a bin of class j is filled with exactly j pieces, so
it never overflows and any worker fills its bins without knowing of others.  A
worker keeps one open bin per class, whatever it reads.

Halves fill their bins to the last token, and a short piece wastes less than
``SHORT`` tokens of its bin.  The bins that are still open when a worker has read
everything are cut at powers of two, where no padding is due: a last bin of t
tokens becomes one sequence per binary digit of t, and a piece that lies across
such a border becomes two.  Short pieces of classes that stay open are laid end to
end first, so that few bins are cut.

Words are encoded once while they are kept: the vocabulary drops white space, so
the ids of a text are those of its words, one after the other.

Nulls and edges: a null or empty text is the end id alone; a null id is carried;
repeated rows are packed as often as they come; an empty table gives an empty one.
Sequence ids are the worker's number times 2^33 plus a count.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.bpe import tokenizer
from wardlight.llm.common import plain, sliced

CAPACITY = 4096
SHORT = 128
END = 2

AT_ONCE = 1 << 20  # characters whose words are looked up together
JOINED = 4096  # new words encoded in one call
KEPT = 500_000  # words whose ids a task keeps, of
KEPT_LENGTH = 64  # characters at most
_WORDS = re.compile("[^ \t\n\r]+")

# Fixed value: the split pattern of the vocabulary.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
MARK = "\U0010ffff"
# Control characters and white space inside a word, special tokens, the mark, a letter that lower-cases by its place.
_RARE = re.compile(r"[\x00-\x1f\x7f-\xa0\u03a3\U0010ffff]|\|>|[^\S\n]")

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@lru_cache(maxsize=2)
def ranked_words(path: str) -> tiktoken.Encoding:
    """The vocabulary for the faster library, over marked words: ids are ranks less ``len(MARK)`` - 1.

    There a token is known by its bytes alone, so the end of a word is a character
    of its own, whose bytes merge first; then comes the word's last byte with it, as
    in the vocabulary, and then the merges in their order.
    """
    mark, model = MARK.encode(), tokenizer(path)
    special = set(model.get_added_tokens_decoder())
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {mark[: n + 2]: n for n in range(len(mark) - 1)}
    for token, i in model.get_vocab().items():
        if i not in special:
            body = token.removesuffix("</w>")
            ranks[bytes(alphabet[c] for c in body) + mark * (body != token)] = i + len(mark) - 1
    return tiktoken.Encoding(path, pat_str=f"[^{MARK}\n]*{MARK}|\n", mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """Ids of texts for a vocabulary that drops white space, by words."""

    def __init__(self, path: str) -> None:
        self.model, self.ranked, self.known = tokenizer(path), ranked_words(path), {}
        self.shift = np.uint32(len(MARK.encode()) - 1)
        self.line = self.ranked.encode_ordinary("\n")[0]

    def learn(self, new: set[str]) -> None:
        """Encode new words, many in one call; rare characters go to the vocabulary's own library."""
        words = list(new)
        if _RARE.search("".join(words)):
            for w in words:
                if _RARE.search(w):
                    self.known[w] = np.array(self.model.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            words = [w for w in words if not _RARE.search(w)]
        for begin in range(0, len(words), JOINED):
            some = words[begin : begin + JOINED]
            marked = _SPLIT.sub(rf"\g<0>{MARK}", unicodedata.normalize("NFC", "\n".join(some)).lower())
            ids = self.ranked.encode_to_numpy(marked)
            ends = [*np.flatnonzero(ids == self.line).tolist(), len(ids)]
            raw, at = (ids - self.shift).astype("<u4").tobytes(), 0
            for w, end in zip(some, ends, strict=True):
                self.known[w] = raw[4 * at : 4 * end]
                at = end + 1

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        begin, known = 0, self.known
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= AT_ONCE):
                size += len(texts[end])
                end += 1
            split = [_WORDS.findall(t) for t in texts[begin:end]]
            if len(known) > KEPT:
                known.clear()
            found = [list(map(known.get, words)) for words in split]
            missing = {w for words, ids in zip(split, found, strict=True) if None in ids for w, i in zip(words, ids, strict=True) if i is None}
            self.learn(missing)
            for words, ids in zip(split, found, strict=True):
                yield b"".join([known[w] if i is None else i for w, i in zip(words, ids, strict=True)] if None in ids else ids)
            for w in missing:
                if len(w) > KEPT_LENGTH:
                    del known[w]
            begin = end


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per worker process, so that later tasks find known words."""
    return WordEncoder(path)


def piece_lengths(n: int, capacity: int = CAPACITY, short: int = SHORT) -> list[int]:
    """Whole sequences, then halves of them by binary digits, then what is left below ``short``."""
    out, rest = [capacity] * (n // capacity), n % capacity
    half = capacity // 2
    while half >= short:
        if rest >= half:
            out.append(half)
            rest -= half
        half //= 2
    return out + [rest] * (rest > 0)


Piece = tuple[int | None, int, int, int, bytes]  # document, start, length, document's tokens, ids


class Packer:
    """One worker's open bins."""

    def __init__(self, worker: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next = capacity, worker << 33
        self.open: dict[int, list[Piece]] = {}

    def new_id(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, piece: Piece) -> Iterator[tuple]:
        count = self.capacity // piece[2]
        held = self.open.setdefault(count, [])
        held.append(piece)
        if len(held) == count:
            yield from self.lay(self.open.pop(count))

    def lay(self, pieces: list[Piece]) -> Iterator[tuple]:
        """A sequence of whole pieces."""
        sequence, offset = self.new_id(), 0
        for doc, start, length, tokens, ids in pieces:
            yield doc, start, length, tokens, sequence, offset, ids
            offset += length

    def close(self) -> Iterator[tuple]:
        """The open bins' pieces, greatest first, in full sequences and then ones that are powers of two."""
        pieces = [p for count in sorted(self.open) for p in self.open[count]]
        rest = sum(p[2] for p in pieces)
        left, sequence, offset = 0, 0, 0
        for doc, start, length, tokens, ids in pieces:
            done = 0
            while done < length:
                if not left:
                    left = min(self.capacity, 1 << (rest.bit_length() - 1))
                    sequence, offset = self.new_id(), 0
                n = min(left, length - done)
                yield doc, start + done, n, tokens, sequence, offset, ids[4 * done : 4 * (done + n)]
                done, offset, left, rest = done + n, offset + n, left - n, rest - n
        self.open.clear()


def packed_rows(texts: Iterator[tuple[list, list[str]]], path: str, worker: int, capacity: int = CAPACITY) -> Iterator[tuple]:
    """The pieces of one worker's documents."""
    packer, end = Packer(worker, capacity), np.array([END], "<u4").tobytes()
    for docs, batch in texts:
        for doc, ids in zip(docs, word_encoder(path).encode(batch), strict=True):
            ids += end
            start, tokens = 0, len(ids) // 4
            for length in piece_lengths(tokens, capacity):
                yield from packer.add((doc, start, length, tokens, ids[4 * start : 4 * (start + length)]))
                start += length
    yield from packer.close()


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids (little-endian 32-bit)."""
    if capacity & (capacity - 1) or capacity < SHORT:
        raise ValueError("the capacity is a power of two")

    def fill(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        texts = ((p.column(0).to_pylist(), p.column(1).to_pylist()) for p in sliced(parts))
        for row in packed_rows(texts, path, TaskContext.get().partitionId(), capacity):
            rows.append(row)
            size += len(row[-1])
            if size > 1 << 23 or len(rows) >= 50_000:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return plain(docs, id_col, text_col).mapInArrow(fill, DDL)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )
