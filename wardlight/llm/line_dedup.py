"""Line dedup: three-line windows that occur earlier in the corpus are removed.

A window is three consecutive lines of a document (``\\n``-separated, compared
exactly, by 128 bits of hash).  Of equal windows the first by document id, then
by position, stays; every line that lies in a later one goes.  Covered positions
are merged, so a run of repeated windows goes as one block.  A line that goes
always has an equal line that stays, at an earlier place.

Nulls and edges: a null text has no lines to remove and stays null; a text of
fewer than three lines has no window; null ids come first; rows that repeat both
id and text are one row and stay or go alike; an empty table gives an empty one.
Other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import KEY, on_key, packed, replaced_text, with_key

LINES = 3


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """One row per window: its two hashes, its document's key, its first line's position."""
    parts = F.split("text", "\n", -1)
    shifted = F.arrays_zip(*[F.slice(parts, k + 1, F.greatest(F.size(parts) - (lines - 1), F.lit(0))).alias(f"l{k}") for k in range(lines)])
    hashed = F.transform(
        shifted,
        lambda w, i: F.struct(
            i.alias("pos"), F.xxhash64(*[w[f"l{k}"] for k in range(lines)]).alias("w1"),
            F.xxhash64(F.lit(1), *[w[f"l{k}"] for k in range(lines)]).alias("w2"),
        ),
    )
    return with_key(docs, id_col, text_col).select(*KEY, F.explode(hashed).alias("w")).select(*KEY, "w.pos", "w.w1", "w.w2")


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """Per document the positions of the windows that occur earlier.

    Windows are counted on the map side first.  The join that follows feeds an
    aggregate on another key, so a window that a third of all documents hold is
    split by adaptive execution.
    """
    found = windows(docs, id_col, text_col, lines).withColumn("at", F.struct(*KEY, "pos"))
    repeated = (
        found.groupBy("w1", "w2").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .where(F.col("first") != F.col("last")).drop("last")
    )
    return (
        found.join(repeated, ["w1", "w2"]).where(F.col("at") != F.col("first"))
        .groupBy(*KEY).agg(F.collect_list("pos").alias("starts"))
    )


def cut(lines: int):
    """Pandas function that drops the lines in windows beginning at ``starts``."""

    def cut_lines(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts in parts:
            out = []
            for text, begins in zip(texts, starts, strict=True):
                if begins is None:
                    out.append((text, text.count("\n") + 1, 0))
                    continue
                rows = text.split("\n")
                gone = {p + k for p in begins for k in range(lines)}
                out.append(("\n".join(r for i, r in enumerate(rows) if i not in gone), len(rows), len(gone)))
            yield pd.DataFrame(out, columns=["kept", "n_lines", "n_removed"])

    return F.pandas_udf(cut_lines, "kept string, n_lines long, n_removed long")


def line_cuts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """Each row packed, with ``cut``: the kept text, the number of lines and of removed ones."""
    starts = later_windows(docs, id_col, text_col, lines)
    return on_key(packed(docs, id_col, text_col), starts, "left").withColumn("cut", cut(lines)("text", "starts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """``docs`` with repeated windows cut out of the texts; every row stays."""
    return replaced_text(line_cuts(docs, id_col, text_col, lines), docs.columns, F.col("cut.kept"), text_col)
