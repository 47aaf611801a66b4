"""What the text operators share: projections of a document table, row keys, Arrow helpers.

A document row is known by its id and a hash of its text (``with_key``), so rows
that share an id (or have none) stay apart as long as their texts differ.  Rows
that repeat both are one row to an operator and get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["doc_id", "text_key"]


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text is an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``plain`` with ``text_key``."""
    return plain(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``with_key`` with the whole row as one column, out of reach of any other name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )


def drawn(rank: Column, rows: int | Column, wanted: int) -> Column:
    """Whether a row may be in a sample of about ``wanted`` of ``rows`` rows, by its 64-bit ``rank``.

    Four times as many pass, so that a sample by least rank is cut from few rows
    however many partitions there are.
    """
    return F.shiftrightunsigned(rank, 11) * F.lit(1.0) * rows < F.lit(4.0 * wanted * (1 << 53))


def on_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on ``KEY`` that keeps one copy of the key, the left one."""
    right = right.withColumnsRenamed({c: f"right_{c}" for c in KEY})
    same = left["doc_id"].eqNullSafe(right["right_doc_id"]) & (left["text_key"] == right["right_text_key"])
    return left.join(right, same, how).drop("right_doc_id", "right_text_key")


def replaced_text(packed_rows: DataFrame, columns: list[str], text: Column, text_col: str = "text") -> DataFrame:
    """The packed rows as they were, with ``text`` where it differs; ``n_chars``, if there is one, follows a changed text."""
    old = F.col("row")[text_col]
    changed = ~F.coalesce(old, F.lit("")).eqNullSafe(text)
    out = []
    for c in columns:
        value = F.col("row")[c]
        if c == text_col:
            value = F.when(changed, text).otherwise(value)
        elif c == "n_chars":
            value = F.when(changed, F.length(text).cast("long")).otherwise(value)
        out.append(value.alias(c))
    return packed_rows.select(*out)


def sliced(parts: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows, so that few texts are Python objects at a time."""
    for part in parts:
        for begin in range(0, part.num_rows, rows):
            yield part.slice(begin, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


# A-Z to a-z; every ASCII character that is no digit or letter to a space.
_PLAIN = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def plain_words(raw: bytes) -> list[bytes]:
    """The maximal stretches of digits, letters and bytes outside ASCII, A-Z lower-cased."""
    return raw.translate(_PLAIN).split()


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open intervals united into maximal ones, in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]
