"""Exact dedup: partitions exchange Golomb-coded fingerprints, then suspects are compared byte by byte.

1. Every input partition sorts the 64-bit fingerprints of its texts, notes which
   occur more than once in it, and sends each owner (a range of fingerprints) its
   run, Golomb-Rice coded.
2. The owner merges the runs and returns to each partition a bitmap: which of its
   fingerprints occur elsewhere too.
3. Coded runs and bitmaps give the suspect fingerprints.  Only suspects' texts are
   grouped, by the texts themselves, so equal fingerprints of different texts do
   no harm.  Of equal texts the row with the greatest id stays.

Groups are aggregated on the map side before any shuffle, and rows get their
group's result by a join that adaptive execution splits when one group is hot.

Nulls and edges: a null text is an empty one; null ids are least; among rows that
repeat both the greatest id and the text, exactly one stays; an empty table gives
an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import plain
from wardlight.session import written

OWNED = 1 << 20  # fingerprints that one owner should get
LEAST_OWNERS = 16

RUN = "source int, owner int, n int, k int, first long, quotients binary, rests binary, twice binary"


# Coding.  Gaps between sorted fingerprints: quotients in unary in one bit string,
# rests of k bits each in another, so that both are decoded without a loop.

def encode(sorted_fps: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Parameter k, first value, coded quotients and rests of increasing 64-bit values."""
    gaps = np.diff(sorted_fps)
    if not len(gaps):
        return 0, int(sorted_fps[0]), b"", b""
    k = max(0, int(math.log2(max(1.0, float(gaps.astype(np.float64).mean()) * math.log(2)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    bits = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, int(sorted_fps[0]), np.packbits(unary).tobytes(), np.packbits(bits).tobytes()


def decode(n: int, k: int, first: int, quotients: bytes, rests: bytes) -> np.ndarray:
    if n == 1:
        return np.array([first], np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)) == 0)[: n - 1]
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps <<= np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(rests, np.uint8))[: (n - 1) * k].reshape(n - 1, k)
        gaps |= (bits.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.uint64(first) + np.r_[np.uint64(0), np.cumsum(gaps, dtype=np.uint64)]


def runs(fps: DataFrame, owners: int) -> DataFrame:
    """The coded runs that the partitions of ``fps`` send to the owners."""
    width = np.uint64((1 << 64) // owners + 1)

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [p.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for p in parts]
        if not held:
            return
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        owner = (values // width).astype(np.int64)
        source, out = TaskContext.get().partitionId(), []
        for begin, end in zip(*_stretches(owner), strict=True):
            k, first, quotients, rests = encode(values[begin:end])
            twice = np.packbits(counts[begin:end] > 1).tobytes()
            out.append((source, owner[begin], end - begin, k, np.uint64(first).view(np.int64), quotients, rests, twice))
        names = [c.split()[0] for c in RUN.split(", ")]
        types = [pa.int32()] * 4 + [pa.int64()] + [pa.binary()] * 3
        arrays = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
        yield pa.record_batch(arrays, names=names)

    return fps.mapInArrow(send, RUN)


def _stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return values, values
    cuts = np.flatnonzero(np.diff(values)) + 1
    return np.r_[0, cuts], np.r_[cuts, len(values)]


def _decoded(row: dict) -> np.ndarray:
    return decode(row["n"], row["k"], int(np.int64(row["first"]).view(np.uint64)), row["quotients"], row["rests"])


def answer(table: pa.Table) -> pa.Table:
    """An owner's bitmaps: for every run, which fingerprints occur twice in it or in another run."""
    rows = table.to_pylist()
    values = [_decoded(r) for r in rows]
    twice = [np.unpackbits(np.frombuffer(r["twice"], np.uint8))[: r["n"]] for r in rows]
    unique, counts = np.unique(np.concatenate(values), return_counts=True)
    dup = counts > 1
    np.logical_or.at(dup, np.searchsorted(unique, np.concatenate(values)), np.concatenate(twice).astype(bool))
    bitmaps = [np.packbits(dup[np.searchsorted(unique, v)]).tobytes() for v in values]
    return pa.table({
        "source": pa.array([r["source"] for r in rows], pa.int32()), "owner": pa.array([r["owner"] for r in rows], pa.int32()),
        "bitmap": pa.array(bitmaps, pa.binary()),
    })


def suspects(fps: DataFrame, owners: int) -> DataFrame:
    """The fingerprints that occur more than once, each once."""
    sent = written(runs(fps, owners), "runs")
    bitmaps = sent.groupBy("owner").applyInArrow(answer, "source int, owner int, bitmap binary")

    def marked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                dup = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8))[: row["n"]].astype(bool)
                yield pa.record_batch([pa.array(_decoded(row)[dup].view(np.int64))], names=["fp"])

    return sent.join(bitmaps, ["source", "owner"]).mapInArrow(marked, "fp long").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owned: int = OWNED) -> DataFrame:
    """Every row's id, the id that stays for its text, the group's size, whether it stays, and the text's SHA-256."""
    rows = plain(docs, id_col, text_col)
    owners = max(LEAST_OWNERS, math.ceil(docs.count() / owned))
    found = written(suspects(rows.select(F.xxhash64("text").alias("fp")), owners), "suspects")
    groups = (
        rows.withColumn("fp", F.xxhash64("text")).join(found, "fp").select("doc_id", "text")
        .groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    # ranked before the join, so that the join's own exchange stands alone and a hot text can be split
    same = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(0)))
    ranked = rows.select("doc_id", F.sha2("text", 256).alias("text_sha256")).withColumn("same", same)
    single = F.col("group_size").isNull()
    return ranked.join(groups, "text_sha256", "left").select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        ((single | F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("same") == 1)).alias("kept"), "text_sha256",
    )
