"""Language identification by compression with per-language dictionaries.

Texts are compared lower-cased, with only their letters.  Fit: a bounded sample of labelled rows per language becomes one raw-content
zstandard dictionary per language.  Predict: a text is compressed with each
dictionary, in blocks so that a long text cannot make up for a poor dictionary by
its own content, and the language whose blocks are smallest in total wins.  The
score is the relative margin to the second; below ``MARGIN`` the text is rejected
(``accepted`` false), though the query still names its best guess.

Bounds: ``SAMPLE_ROWS`` rows per language (those whose ids and texts have the least hashes),
``SAMPLE_BYTES`` bytes of each, ``DICTIONARY`` bytes of dictionary, and at most
``LANGUAGES`` languages (checked: more raise an error).

Nulls and edges: a null text, or one without a letter, is ``und`` with score 0
and not accepted; with no labelled rows at all every text is ``und``; with a
single learned language it always wins with score 1; equal sizes go to the
language that sorts first; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import drawn

SAMPLE_ROWS = 256
SAMPLE_BYTES = 1024
DICTIONARY = 112 * 1024
LANGUAGES = 256
BLOCK = 1024
MARGIN = 0.01
UNKNOWN = "und"

# Greedy matching of at least four bytes: the cheapest setting that finds the word endings a language shares.
PARAMETERS = {
    "strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "search_log": 4, "hash_log": 16, "chain_log": 16, "window_log": 18,
    "write_content_size": False, "write_checksum": False, "write_dict_id": False,
}
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased, with everything between letters as one space."""
    return _OTHER.sub(" ", text.lower()).encode()


def slices(text: bytes, size: int = SAMPLE_BYTES, parts: int = 2) -> bytes:
    """``size`` bytes of a sampled text from evenly spread places."""
    if len(text) <= size:
        return text
    step = size // parts
    return b"".join(text[b : b + step] for b in np.linspace(0, len(text) - step, parts).astype(int).tolist())


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of the labelled rows with ``train``.

    The sampled ids are found from ids and labels alone; the rank is limited on
    the map side, and only the sampled texts' slices come to the driver.
    """
    labelled = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labels = labelled.groupBy(F.col(lang_col).alias("lang")).count().limit(LANGUAGES + 1).collect()
    if len(labels) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not labels:
        return {}
    # ranked by id and text; of a frequent language only the few rows of low rank enter the window
    counts = F.create_map(*[x for r in labels for x in (F.lit(r["lang"]), F.lit(r["count"]))])
    rank = F.xxhash64(id_col, text_col)
    order = Window.partitionBy("lang").orderBy("rank", "id")
    ids = labelled.where(drawn(rank, counts[F.col(lang_col)], SAMPLE_ROWS)).select(
        F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.shiftrightunsigned(rank, 11).alias("rank"))
    chosen = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_ROWS).select("id", "lang", "rank").distinct()
    texts = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.shiftrightunsigned(rank, 11).alias("rank"), F.col(text_col).alias("text"))

    @F.pandas_udf("binary")
    def slice_(t: pd.Series) -> pd.Series:
        return t.map(lambda x: slices(letters(x)))

    rows = (
        # at most SAMPLE_ROWS ids for each of LANGUAGES languages, so the broadcast is bounded
        texts.join(F.broadcast(chosen), texts["id"].eqNullSafe(chosen["id"]) & (texts["lang"] == chosen["lang"]) & (texts["rank"] == chosen["rank"]))
        .select(texts["lang"], texts["id"], texts["rank"], slice_("text").alias("part"))
        .dropDuplicates(["lang", "id", "rank"]).collect()
    )
    out: dict[str, bytes] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out[row["lang"]] = out.get(row["lang"], b"") + bytes(row["part"]) + b"\n"
    return {lang: text[-DICTIONARY:] for lang, text in out.items()}


class Compressors:
    """One compressor per dictionary, ready for a task."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = sorted(dictionaries)
        params = zstandard.ZstdCompressionParameters(**PARAMETERS)
        self.made = []
        for name in self.names:
            held = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            self.made.append(zstandard.ZstdCompressor(dict_data=held, compression_params=params))

    def judge(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """Language, score, and whether the margin suffices."""
        if text is None or not self.names or not (text.isalpha() or any(map(str.isalpha, text))):
            return UNKNOWN, 0.0, False
        raw = letters(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.made]
        best, second = np.argsort(sizes, kind="stable")[:2] if len(sizes) > 1 else (0, None)
        score = 1.0 if second is None else (sizes[second] - sizes[best]) / sizes[second]
        return self.names[best], float(score), score >= margin


def language(text: Column, dictionaries: dict[str, bytes], margin: float = MARGIN) -> Column:
    """Struct of ``lang_pred``, ``score`` and ``accepted`` for a text column."""

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Compressors(dictionaries)
        for part in parts:
            yield pd.DataFrame([own.judge(t, margin) for t in part], columns=["lang_pred", "score", "accepted"])

    return judge(text)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is in the fold kept from learning, by the CRC-32 of its id as text; a row without id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
