"""Suffix-array dedup: byte strings of ``length`` bytes that start anywhere else in the corpus are removed.

Method.  A repeat is a group of places that share a string of ``length`` bytes or
more.  The suffixes that can start one are sorted, and a stack-scan of their
common prefixes gives the tree of prefix intervals; an interval whose members
agree on enough bytes to the left as well is a repeat with all its occurrences,
not just the neighbours.  Which members agree how far to the left is the test of
left diversity.

Distribution.  A suffix array of everything is not needed.  Each window of
``length`` bytes has an anchor, the ``gram`` bytes in it whose hash is least (the
first of equals), and equal windows have equal anchors at equal offsets.  So
repeats are found among the occurrences of one anchor:

1. Every document gives its anchors: a run of neighbouring windows with the same
   anchor is one occurrence, known by the hash of the anchor and a 128-bit hash of
   its whole stretch.  About one place in 150 is an anchor.
2. Occurrences are counted by both hashes.  A stretch that occurs twice is removed
   whole and stands for all its copies from here on.  An anchor that has one
   stretch only is done.  This is counting with a map-side part, so groups of
   copies of any size cost nothing.
3. The other stretches are fetched from their documents.  Those of one anchor are
   sorted (a sparse enhanced suffix array: one suffix per stretch, the anchor's)
   and scanned as above.
4. An anchor with more than ``CAP`` different stretches (a passage that a great
   part of all documents embed) is split by content: all its windows are hashed
   and counted, which gives the same result with no group in one task.
5. Removed windows go back to their documents, which are cut.

Nulls and edges: a null text is empty; a text shorter than ``length`` loses
nothing; a string that occurs twice within one text, overlaps included, loses both
occurrences; rows that repeat id and text are one row and no copy of each other;
rows of equal text and different ids, null ids among them, are copies; an empty
table gives an empty one.  Bytes are judged, so a kept text may begin or end
inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import KEY, merged, on_key, packed, replaced_text, sliced, text_bytes, with_key
from wardlight.session import written

LENGTH = 400
GRAM = 100
CAP = 4096  # different stretches of an anchor that one task sorts
TOGETHER = 1024  # stretches that one call of the scan should get

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_SEGMENT = 1 << 18  # bytes hashed at a time
_WORD = (1 << 64) - 1
_LOW = np.uint64((1 << 22) - 1)  # place in the segment, in the low bits of a hash

ANCHORS = "doc_id long, text_key long, a long, c1 long, c2 long, lo long, hi long, off int, size int, times long"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    up, down = np.full(n, base), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(_SEGMENT + 4096)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hashes of all ``gram`` bytes of a segment."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[: len(raw)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _DOWN[: len(raw) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours: from each block's running least to its right and to its left."""
    n = len(values)
    whole = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    whole[:n] = values
    blocks = whole.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, and first and last window start of each run of windows with one anchor."""
    starts, out = len(raw) - length + 1, []
    for begin in range(0, starts, _SEGMENT):
        end = min(begin + _SEGMENT, starts)
        part = raw[begin : end + length - 1]
        hashes = gram_hashes(part, gram)
        marked = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        least = sliding_least(marked, length - gram + 1)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        place = (least[first] & _LOW).astype(np.int64)
        out.append((hashes[place], begin + place, begin + first, begin + np.r_[first[1:], len(least)] - 1))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def occurrences(raw: bytes, length: int, gram: int) -> list[tuple]:
    """(a, c1, c2, lo, hi, off, size, times) of a text's anchors; equal neighbours in step are one, with ``times`` above 1."""
    hashes, places, los, his = anchors(np.frombuffer(raw, np.uint8), length, gram)
    out: list[tuple] = []
    for a, p, lo, hi in zip(hashes.view(np.int64).tolist(), places.tolist(), los.tolist(), his.tolist(), strict=True):
        c = xxhash.xxh3_128_intdigest(raw[lo : hi + length])
        # the place of the anchor counts too
        c1, c2 = ((c >> 64) + (p - lo) * _BASE & _WORD) - (1 << 63), (c & _WORD) - (1 << 63)
        if out and out[-1][:3] == (a, c1, c2) and out[-1][4] + 1 == lo:
            out[-1] = (*out[-1][:4], hi, *out[-1][5:7], out[-1][7] + 1)
        else:
            out.append((a, c1, c2, lo, hi, p - lo, hi + length - lo, 1))
    return out


# The scan.

def _common(rows: list[bytes], width: int) -> np.ndarray:
    """Length of the common prefix of each two neighbours, up to ``width``."""
    flat = np.frombuffer(b"".join([r[:width].ljust(width, b"\0") for r in rows]), np.uint8).reshape(len(rows), width)
    sizes = np.array([min(len(r), width) for r in rows])
    differ = flat[1:] != flat[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Prefix intervals (length, first, last) of a suffix array by a stack-scan, inner ones first; shorter than ``least`` left out."""
    stack: list[tuple[int, int]] = []
    for i, height in enumerate([*lcp.tolist(), -1]):
        begin = i
        while stack and stack[-1][0] > height:
            high, begin = stack.pop()
            if high >= least:
                yield high, begin, i
        if not stack or stack[-1][0] < height:
            stack.append((height, begin))


def repeats(rights: np.ndarray, lefts: np.ndarray, left_rank: np.ndarray, length: int, most_left: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Repeat groups of one anchor's stretches, given in the order of what follows the anchor.

    ``rights`` are common prefixes of neighbours in that order, ``lefts`` common
    suffixes of what comes before, of neighbours in the order ``left_rank``.  Gives,
    for each interval, its common length to the right, its members, and how far each
    agrees to the left with another member.
    """
    for right, first, last in intervals(rights, length - most_left):
        members = np.arange(first, last + 1)
        members = members[np.argsort(left_rank[members])]
        ranks = left_rank[members]
        near = np.minimum.reduceat(lefts, ranks[:-1]) if len(ranks) > 2 else np.array([lefts[ranks[0] : ranks[1]].min()])
        if len(ranks) > 2:  # the last stretch of reduceat would run to the end
            near[-1] = lefts[ranks[-2] : ranks[-1]].min()
        yield right, members, np.maximum(np.r_[near, 0], np.r_[0, near])


def scan(a: np.ndarray, off: np.ndarray, raw: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(stretch, first, last): windows of each stretch, by their start in it, that occur in another stretch of its anchor."""
    most_left = int(off.max())
    rights = [r[o:] for r, o in zip(raw, off.tolist(), strict=True)]
    lefts = [r[:o][::-1] for r, o in zip(raw, off.tolist(), strict=True)]
    keys = a.tolist()
    order = sorted(range(len(raw)), key=lambda i: (keys[i], rights[i]))
    left_order = sorted(range(len(raw)), key=lambda i: (keys[i], lefts[i]))
    right_lcp = _common([rights[i] for i in order], length)
    left_lcp = _common([lefts[i] for i in left_order], max(1, most_left))
    rank = np.empty(len(raw), np.int64)
    rank[left_order] = np.arange(len(raw))
    order, a = np.array(order), a[np.array(order)]
    bounds = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        n, members = end - begin, order[begin:end]
        if n < 2:
            continue
        if n == 2:
            right, left = int(right_lcp[begin]), int(left_lcp[begin])
            if length - right <= left:
                for i in members.tolist():
                    yield i, int(off[i]) - left, int(off[i]) - max(length - right, 0)
            continue
        marks = np.zeros((n, most_left + 2), np.int32)
        for right, group, left in repeats(right_lcp[begin : end - 1], left_lcp[begin : end - 1], rank[members] - begin, length, most_left):
            least = max(length - right, 0)
            far = left >= least
            np.add.at(marks, (group[far], least), 1)
            np.add.at(marks, (group[far], left[far] + 1), -1)
        held = np.pad((np.cumsum(marks, axis=1) > 0).astype(np.int8), ((0, 0), (1, 1)))
        edge = np.diff(held, axis=1)
        for (k, first), (_, after) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist(), strict=True):
            i = members[k]
            yield int(i), int(off[i]) - (after - 1), int(off[i]) - first


# The job.

def find_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    types = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()]
    schema = pa.schema([(c.split()[0], t) for c, t in zip(ANCHORS.split(", "), types, strict=True)])

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            out: list[tuple] = []
            for doc, key, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), text_bytes(part.column(2)), strict=True):
                if len(raw) >= length:
                    out += [(doc, key, *o) for o in occurrences(raw, length, gram)]
                if len(out) > 50_000:
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)

    return rows.select("doc_id", "text_key", "text").mapInArrow(find, ANCHORS)


def repeated_stretches(found: DataFrame) -> DataFrame:
    """Stretches of anchors that occur more than once: times, number of stretches of the anchor, one place."""
    first = [F.first(c).alias(c) for c in ("doc_id", "text_key", "lo", "off", "size")]  # of one row, in each partial result as in the whole
    counted = found.groupBy("a", "c1", "c2").agg(F.sum("times").alias("times"), *first)
    by_anchor = counted.groupBy("a").agg(F.count("*").alias("stretches"), F.sum("times").alias("all")).where("all > 1").drop("all")
    return counted.join(by_anchor, "a")


def fetch(rows: DataFrame, stretches: DataFrame) -> DataFrame:
    """The bytes of stretches, from their documents."""
    places = stretches.groupBy(*KEY).agg(F.collect_list(F.struct("a", "c1", "c2", "lo", "off", "size", "stretches")).alias("places"))

    def slice_(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            out = []
            for raw, own in zip(text_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                out += [(p["a"], p["c1"], p["c2"], p["off"], p["stretches"], raw[p["lo"] : p["lo"] + p["size"]]) for p in own]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * 3, pa.int32(), pa.int64(), pa.binary()], strict=True)],
                                  names=["a", "c1", "c2", "off", "stretches", "raw"])

    # rows that repeat id and text are one, so their stretches are fetched once
    once = on_key(rows, places, "inner").select("text", "places", *KEY).dropDuplicates(KEY)
    return once.select("text", "places").mapInArrow(slice_, "a long, c1 long, c2 long, off int, stretches long, raw binary")


def windows_by_scan(stretches: DataFrame, length: int, groups: int) -> DataFrame:
    """(a, c1, c2, first, last) of windows found by the scan, over stretches dealt by anchor."""

    def run(table: pa.Table) -> pa.Table:
        c = {n: table.column(n).to_numpy() for n in ("a", "c1", "c2", "off")}
        found = np.array(list(scan(c["a"], c["off"], table.column("raw").to_pylist(), length)), np.int64).reshape(-1, 3)
        i = found[:, 0]
        return pa.table({"a": c["a"][i], "c1": c["c1"][i], "c2": c["c2"][i], "first": found[:, 1], "last": found[:, 2]})

    dealt = stretches.withColumn("deal", F.pmod(F.xxhash64("a"), F.lit(groups)))
    return dealt.groupBy("deal").applyInArrow(run, "a long, c1 long, c2 long, first long, last long")


def windows_by_count(stretches: DataFrame, length: int) -> DataFrame:
    """The same by hashing every window, for anchors of too many stretches for one task."""
    ddl = "a long, c1 long, c2 long, at long, w1 long, w2 long"

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                raw = row["raw"]
                n = len(raw) - length + 1
                hashes = np.array([divmod(xxhash.xxh3_128_intdigest(raw[i : i + length]), 1 << 64) for i in range(n)], np.uint64).view(np.int64)
                yield pa.record_batch([
                    pa.array(np.full(n, row["a"])), pa.array(np.full(n, row["c1"])), pa.array(np.full(n, row["c2"])),
                    pa.array(np.arange(n)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]),
                ], names=["a", "c1", "c2", "at", "w1", "w2"])

    found = stretches.mapInArrow(each, ddl)
    twice = found.groupBy("w1", "w2").count().where("count > 1").drop("count")
    return found.join(twice, ["w1", "w2"]).select("a", "c1", "c2", F.col("at").alias("first"), F.col("at").alias("last"))


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, cap: int = CAP,
) -> DataFrame:
    """Per document key the ``spans`` (start, end in bytes) covered by repeated strings, unmerged."""
    if gram > length:
        raise ValueError("an anchor is no longer than a window")
    rows = with_key(docs, id_col, text_col)
    # rows that repeat id and text give their anchors once
    found = written(find_anchors(rows, length, gram).dropDuplicates([*KEY, "lo"]), "anchors")
    known = written(repeated_stretches(found), "stretches")
    several = known.where("stretches > 1")
    fetched = written(fetch(rows, several), "fetched")
    groups = max(1, several.count() // TOGETHER)
    windows = windows_by_scan(fetched.where(F.col("stretches") <= cap), length, groups).union(
        windows_by_count(fetched.where(F.col("stretches") > cap), length))
    part = windows.groupBy("a", "c1", "c2").agg(F.collect_list(F.struct("first", "last")).alias("windows"))
    whole = known.where("times > 1").select("a", "c1", "c2", F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("windows"))
    marks = part.join(whole.select("a", "c1", "c2"), ["a", "c1", "c2"], "left_anti").union(whole)
    covered = found.join(written(marks, "marks"), ["a", "c1", "c2"]).select(*KEY, F.when(
        F.col("windows").isNull(), F.array(F.struct(F.col("lo").alias("start"), (F.col("hi") + length).alias("end")))
    ).otherwise(F.transform("windows", lambda w: F.struct((F.col("lo") + w["first"]).alias("start"), (F.col("lo") + w["last"] + length).alias("end")))).alias("spans"))
    return covered.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def cut(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    if not spans:
        return raw, 0, 0
    starts, ends = merged(np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))
    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(raw)]
    kept = b"".join([raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)])
    return kept, len(raw) - len(kept), len(starts)


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, cap: int = CAP,
) -> DataFrame:
    """Per row ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay."""
    spans = repeated_windows(docs, id_col, text_col, length, gram, cap)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            raws = text_bytes(part.column(1))
            out = [cut(raw, own) for raw, own in zip(raws, part.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([
                part.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                pa.array([o[2] for o in out], pa.int64()), pa.array([o[0] for o in out], pa.binary()),
            ], schema=schema)

    rows = on_key(with_key(docs, id_col, text_col), spans, "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(cut_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(kept: DataFrame) -> DataFrame:
    """The hash and the number of the kept bytes instead of them."""
    return kept.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("kept_bytes"))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, cap: int = CAP,
) -> DataFrame:
    """``docs`` with repeats cut out of the texts (broken characters at the cuts dropped); every row stays."""
    spans = repeated_windows(docs, id_col, text_col, length, gram, cap)

    @F.pandas_udf("string")
    def cut_text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, own in parts:
            yield texts.combine(own, lambda t, s: t if s is None else cut(t.encode(), list(s))[0].decode("utf-8", "ignore"))

    rows = on_key(packed(docs, id_col, text_col), spans, "left")
    return replaced_text(rows, docs.columns, cut_text("text", "spans"), text_col)
