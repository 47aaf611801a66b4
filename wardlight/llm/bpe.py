"""BPE encoding and decoding, exact, with long texts encoded in pieces and joined as a tree.

A text may be cut between a character that is no white space and white space
without changing any token: no token and no look-ahead of the split pattern spans
such a place.  The same holds before and after a special token.

A text longer than ``LONG`` characters goes to several tasks, cut at such places
where there is one.  Where there is none (long unsplit text) it is cut anywhere,
and each such piece is halved again inside its task.  Halves are encoded on their
own; around each join a growing window of whole tokens is encoded again until its
first tokens are the left half's at that place and its last ones the right half's.
Ids left of the window, of the window, and right of it are then the text's: a
sequence of BPE tokens is the encoding of its text if every two neighbours are the
encoding of theirs.

Nulls and edges: a null or empty text has no ids; rows that repeat id and text are
answered one by one; special tokens spelled out in a text are recognised as the
library does; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardlight.llm.common import KEY, sliced, with_key

LONG = 32_768  # characters of a text, and of a piece, that one task encodes
HALF = 4_096  # characters of unsplit text that are encoded in one call

# Fixed value: the split pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ODD = re.compile("[\x1c-\x1f]")  # white space to one library, not to the other


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; added tokens stand for their own text."""
    # The byte alphabet: printable bytes stand for themselves, the others follow from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    model = tokenizer(path)
    added = model.get_added_tokens_decoder()
    table = [b""] * model.get_vocab_size()
    for token, i in model.get_vocab().items():
        table[i] = added[i].content.encode() if i in added else bytes(alphabet[c] for c in token)
    return table


Spans = tuple[list[int], list[tuple[int, int]]]  # ids and their places in the text


def encoded(path: str, text: str) -> Spans:
    out = tokenizer(path).encode(text, add_special_tokens=False)
    return out.ids, out.offsets


def joined(path: str, text: str, cut: int, left: Spans, right: Spans) -> Spans:
    """The encoding of ``text`` from those of its parts before and after ``cut``; the right one's places are in ``text`` already."""
    (a, at), (b, bt) = left, right
    if not a or not b:
        return (a or b), (at or bt)
    width = 4
    while True:
        i, j = max(0, len(a) - width), min(len(b), width)
        begin, end = at[i][0] if i else 0, bt[j - 1][1] if j < len(b) else len(text)
        ids, places = encoded(path, text[begin:end])
        places = [(s + begin, e + begin) for s, e in places]
        starts = i == 0 or (ids[:2] == a[i : i + 2] and places[:2] == at[i : i + 2])
        ends = j == len(b) or (ids[-2:] == b[j - 2 : j] and places[-2:] == bt[j - 2 : j])
        if starts and ends:
            return a[:i] + ids + b[j:], at[:i] + places + bt[j:]
        width *= 2


def outside(special: re.Pattern[str] | None, text: str, cut: int) -> int:
    """``cut``, or the start (else the end) of the special token that it falls into; those are never cut."""
    for found in special.finditer(text, max(0, cut - 64)) if special else ():
        if found.start() >= cut:
            break
        if cut < found.end():
            return found.start() or found.end()
    return cut


@lru_cache(maxsize=4)
def special_tokens(path: str) -> re.Pattern[str] | None:
    found = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


def tree(path: str, text: str, limit: int = HALF) -> Spans:
    """Encoding by halves; each half stands for itself until the join."""
    cut = outside(special_tokens(path), text, len(text) // 2)
    if len(text) <= limit or cut == len(text):
        return encoded(path, text)
    ids, places = tree(path, text[cut:], limit)
    return joined(path, text, cut, tree(path, text[:cut], limit), (ids, [(s + cut, e + cut) for s, e in places]))


@lru_cache(maxsize=4)
def ranked(path: str) -> tiktoken.Encoding:
    """The same vocabulary for the faster library: a token's rank among the merges is its id."""
    model = tokenizer(path)
    special = {t.content: i for i, t in model.get_added_tokens_decoder().items()}
    ranks = {raw: i for i, raw in enumerate(byte_table(path)) if i not in special.values()}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode_text(path: str, text: str) -> bytes:
    """A text's ids as little-endian 32-bit numbers, in one call."""
    return ranked(path).encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def decoded(path: str, ids: np.ndarray) -> str:
    table = byte_table(path)
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


# Long texts: pieces, and their joins.

def cuts(text: str, size: int, special: re.Pattern[str] | None = None) -> list[tuple[int, bool]]:
    """Places to cut a text into pieces of at most about ``size`` characters, and whether tokens end there for sure."""
    out, at = [], 0
    while len(text) - at > size:
        begin, end = at + size // 2, at + size
        place = next((i for i in range(end, begin, -1) if text[i] in " \n\t\r" and not text[i - 1].isspace()), None)
        odd = _ODD.search(text, begin, end + 1) is not None
        sure = place is not None and not odd
        at = place if sure else at + outside(special, text[at : end + 64], size)
        if at < len(text):
            out.append((at, sure))
    return out


def join_pieces(path: str, pieces: list[tuple[str, bytes, bytes, bool]]) -> bytes:
    """Ids of a text from its pieces (text, ids, ends of the tokens in the piece, cut for sure before it)."""
    run: list[tuple[str, Spans]] = []  # neighbours whose cuts are not for sure
    out = []

    def close() -> None:
        while len(run) > 1:  # neighbours in pairs, level by level
            run[:] = [pair(run[i], run[i + 1]) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
        if run:
            out.append(np.array(run[0][1][0], np.uint32).tobytes())
        run.clear()

    def pair(a: tuple[str, Spans], b: tuple[str, Spans]) -> tuple[str, Spans]:
        n = len(a[0])
        return a[0] + b[0], joined(path, a[0] + b[0], n, a[1], (b[1][0], [(s + n, e + n) for s, e in b[1][1]]))

    for k, (text, ids, places, sure) in enumerate(pieces):
        if sure or not k:
            close()
        whole = k + 1 < len(pieces) and not pieces[k + 1][3] or not sure and k
        if not whole:
            out.append(ids)
            continue
        spans = np.frombuffer(places, np.uint32).reshape(-1, 2).tolist()
        run.append((text, (np.frombuffer(ids, np.uint32).tolist(), [tuple(s) for s in spans])))
    close()
    return b"".join(out)


def as_ids(ids: list[bytes]) -> list[pa.Array]:
    return [pa.array(ids, pa.binary())]


def bpe_encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG,
    finish: Callable[[list[bytes]], list[pa.Array]] = as_ids, columns: str = "ids binary",
) -> DataFrame:
    """``doc_id``, ``text_key`` and ``ids`` (little-endian 32-bit numbers) of every row's whole text.

    Texts of at most ``long`` characters are encoded where they are read.  Longer
    ones are cut, dealt out piece by piece, and joined by document.  ``finish`` makes
    the ``columns`` that are wanted from the ids of some rows, in the worker that has
    them: a second Python step would double the workers, and each holds the vocabulary.
    """
    rows = with_key(docs, id_col, text_col)
    names = ["doc_id", "text_key", *[c.split()[0] for c in columns.split(", ")]]

    def short(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            ids = [encode_text(path, t) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(2), *finish(ids)], names=names)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            for doc, text, key, copies in zip(*[c.to_pylist() for c in part.columns], strict=True):
                at = [(0, True), *cuts(text, long, special_tokens(path))]
                ends = [a for a, _ in at[1:]] + [len(text)]
                texts = [text[b:e] for (b, _), e in zip(at, ends, strict=True)]
                n = len(texts)
                loose = [not sure or k + 1 < n and not at[k + 1][1] for k, (_, sure) in enumerate(at)]
                yield pa.record_batch([
                    pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array([copies] * n, pa.int64()),
                    pa.array(range(n), pa.int32()), pa.array(texts, pa.string()), pa.array([s for _, s in at], pa.bool_()), pa.array(loose, pa.bool_()),
                ], names=["doc_id", "text_key", "copies", "piece", "text", "sure", "loose"])

    def piece(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            ids, places, texts = [], [], []
            for text, loose in zip(columns["text"].to_pylist(), columns["loose"].to_pylist(), strict=True):
                if loose:  # to be joined: the places of the tokens are needed, and the text
                    a, at = tree(path, text)
                    ids.append(np.array(a, np.uint32).tobytes())
                    places.append(np.array(at, np.uint32).tobytes())
                    texts.append(text)
                else:
                    ids.append(encode_text(path, text))
                    places.append(b"")
                    texts.append("")
            yield pa.record_batch([
                columns["doc_id"], columns["text_key"], columns["copies"], columns["piece"], columns["sure"],
                pa.array(texts, pa.string()), pa.array(ids, pa.binary()), pa.array(places, pa.binary()),
            ], names=["doc_id", "text_key", "copies", "piece", "sure", "text", "ids", "places"])

    def join(table: pa.Table) -> pa.Table:
        pieces = sorted(table.to_pylist(), key=lambda r: r["piece"])
        ids = join_pieces(path, [(r["text"], r["ids"], r["places"], r["sure"]) for r in pieces])
        n = pieces[0]["copies"]
        one = [pa.array([pieces[0]["doc_id"]], pa.int64()), pa.array([pieces[0]["text_key"]], pa.int64()), *finish([ids])]
        return pa.table([pa.concat_arrays([c] * n) for c in one], names=names)

    ddl = f"doc_id long, text_key long, {columns}"
    here = rows.where(F.length("text") <= long).select("doc_id", "text", "text_key").mapInArrow(short, ddl)
    # rows that repeat id and text are joined once and given as often as they came
    longs = rows.where(F.length("text") > long).groupBy("doc_id", "text", "text_key").agg(F.count("*").alias("copies"))
    pieces = longs.select("doc_id", "text", "text_key", "copies").mapInArrow(
        cut, "doc_id long, text_key long, copies long, piece int, text string, sure boolean, loose boolean")
    dealt = pieces.repartition(F.xxhash64("doc_id", "text_key", "piece"))
    there = dealt.mapInArrow(piece, "doc_id long, text_key long, copies long, piece int, sure boolean, text string, ids binary, places binary")
    return here.union(there.groupBy(*KEY).applyInArrow(join, ddl))


def bpe_decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with ``decoded``, the text of ``ids`` (special tokens included)."""

    def decode(ids):
        return ids.map(lambda x: decoded(path, np.frombuffer(x, np.uint32)))

    return tokens.withColumn("decoded", F.pandas_udf(decode, "string")("ids"))


@lru_cache(maxsize=4)
def decimals(path: str) -> list[str]:
    """Every id of a vocabulary as a decimal number."""
    return list(map(str, range(tokenizer(path).get_vocab_size())))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """Per row the number of ids, and the hashes of the id list and of the decoded text."""

    def digest(raws: list[bytes]) -> list[pa.Array]:
        names, n, ids_sha, text_sha = decimals(path), [], [], []
        for raw in raws:
            ids = np.frombuffer(raw, np.uint32)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join([names[i] for i in ids.tolist()]).encode()).hexdigest())
            text_sha.append(hashlib.sha256(decoded(path, ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    found = bpe_encode(docs, path, id_col, text_col, long, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.drop("text_key")
