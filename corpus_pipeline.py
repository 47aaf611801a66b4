"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as
Parquet and read again for the next.  All but the last return the columns of
``documents``.  Every row of a stage's input is judged; nulls, empty texts and
repeated rows are treated as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import language_id, line_dedup, packing, simhash, suffix_dedup
from wardlight.llm.common import on_key, packed
from wardlight.session import written
from wardlight.sources.driver_tables import driver_table

# Bytes of a repeat that the suffix stage takes out.  A passage of 51 words has 270 bytes or more in the languages
# at hand; a repeat of about 49 words is found wherever it is embedded.
PASSAGE_BYTES = 260
ANCHOR_BYTES = 40  # short anchors lie further apart, so fewer rows are shuffled


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; learned from the labelled ones."""
    found = language_id.language(F.col("row.text"), language_id.fit(docs, F.lit(True)))
    return packed(docs).withColumn("accepted", found["accepted"]).where("accepted").select("row.*")


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat in windows of three."""
    return line_dedup.line_dedup(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id."""
    stays = simhash.simhash_groups(docs).where("stays").select("doc_id", "text_key")
    # rows that repeat id and text are one row
    return on_key(packed(docs), stays.distinct(), "inner").dropDuplicates(["doc_id", "text_key"]).select("row.*")


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of ``PASSAGE_BYTES`` that occur elsewhere.

    The length is the pipeline's own: short enough for passages of over 50 words
    that lie in several documents, long enough to leave common phrases alone.
    """
    return suffix_dedup.without_repeats(docs, length=PASSAGE_BYTES, gram=ANCHOR_BYTES)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_lines),
    ("simhash_near_dedup", remove_near_copies),
    ("suffix_dedup", remove_repeats),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table."""
    docs = driver_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


# Compression, fingerprints and tokens are not SQL's; tests/llm holds the stages against plain Python.
ORACLE_SQL = None
