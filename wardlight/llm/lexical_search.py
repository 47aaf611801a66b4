"""Ranked lexical search: norm-ordered buckets of impact vectors, pruned by Cauchy-Schwarz and by coordinates.

Each document is a vector of impacts, one coordinate per term; an item is a vector
of term weights; the score is their inner product.  All numbers of the result are
integers (weights, impacts, scores); floating point serves only for bounds.

Weights and impacts (``N`` documents with a term, ``L`` their terms in all, ``n`` terms
of one document, ``tf`` of them the term, ``df`` documents with the term):

    weight  w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))
    m         = 50 + (50 * n * N) div L
    impact    = (1000000000 * tf) div (1000 * tf + 20 * m)
    score     = sum of w * impact over the item's distinct terms

Job:

1. The items are dealt into blocks of about ``BLOCK_TERMS`` terms, and each block is
   searched against all documents; one block's terms are what the driver and a
   worker hold.
2. One pass over the texts keeps, of each document, n and the counts of the block's
   terms (written to the shared folder).  N, L, df and the distribution of norms
   are aggregates of that.
3. The documents of the greatest norms, about ``LEAD`` of them, are searched first.
   The k-th best score of an item there is a threshold for all others.
4. Every task sorts its documents by norm and cuts them into buckets.  A bucket, and
   all after it, are passed over for an item if |item| * (greatest norm) is below
   the threshold (Cauchy-Schwarz).  Inside a bucket the item's heaviest
   coordinates are added up; what the other coordinates can add is at most the
   lesser of |rest of item| * |rest of document| and the sum of the bucket's
   greatest impacts; documents that cannot reach the threshold go.  The rest are
   scored exactly in 64-bit integers, and the task's own k-th best raises the
   threshold.  Equal scores never go, so ties are whole.
5. Tasks give at most k rows per item; these are cut to k again in salted groups
   and then by item, so no group grows with the number of tasks.

Nulls and edges: terms are maximal stretches of digits, letters and anything
outside ASCII, A-Z lower-cased; null and empty texts have none and are in no
result; an item without terms, or a null one, has no rows; items that share an id
are one item with the terms of all; equal scores go by ascending document id (null
ids last); rows that repeat an id are ranked one by one; a table without
documents, or without items, gives an empty result; only the named columns are
read, so others cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import plain, plain_words, sliced, text_bytes
from wardlight.session import written

BLOCK_TERMS = 1 << 18  # terms of the items searched in one pass
LEAD = 4096  # documents searched first, about
BUCKET = 1024  # documents of a bucket
HELD = 1 << 21  # coordinates a task sorts at a time
FOCUS = 0.75  # of the item's squared norm that the heaviest coordinates hold
SALTS = 64

HITS = "item int, doc_id long, score long"


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term) of the items' distinct terms."""

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts, 64):
            pairs = [(i, w.decode()) for i, raw in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True) for w in set(plain_words(raw))]
            yield pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], names=["item_id", "term"])

    return plain(items, id_col, text_col).mapInArrow(split, "item_id long, term string").distinct()


def counted_terms(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Per document with a term: doc_id, n, and the numbers and counts of those of ``terms`` that it has."""
    spelled = [t.encode() for t in terms]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(spelled)}
        get = number.get
        for part in sliced(parts):
            ids, sizes, keys = [], [], []
            for doc, raw in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True):
                words = plain_words(raw)
                if words:
                    known = np.array([k for k in map(get, words) if k is not None], np.int64)
                    keys.append(known + len(ids) * len(number))
                    ids.append(doc)
                    sizes.append(len(words))
            if not ids:
                continue
            codes, times = np.unique(np.concatenate(keys), return_counts=True)
            offsets = pa.array(np.searchsorted(codes, np.arange(len(ids) + 1) * len(number)).astype(np.int32))
            yield pa.record_batch([
                pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array((codes % max(1, len(number))).astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
            ], names=["doc_id", "n", "terms", "times"])

    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<int>")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(times: np.ndarray, n: np.ndarray, sizes: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Impacts of coordinates that lie one document after the other, ``sizes`` of each."""
    m = 50 + np.array([50 * x * documents // length for x in n.tolist()], np.int64)  # whole numbers of any size before the division
    return 1_000_000_000 * times // (1000 * times + np.repeat(20 * m, sizes))


class Items:
    """A block's items: their terms by falling weight, and how many of them are the focus."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray) -> None:
        self.terms, self.weights, self.norms, self.focus, self.rest = [], [], [], [], []
        for own in terms:
            own = own[np.argsort(-weight[own], kind="stable")]
            w = weight[own]
            squares = np.cumsum(w.astype(np.float64) ** 2)
            total = float(squares[-1]) if len(own) else 0.0
            heavy = int(np.searchsorted(squares, FOCUS * total)) + 1
            self.terms.append(own)
            self.weights.append(w)
            self.norms.append(math.sqrt(total))
            self.focus.append(min(heavy, len(own)))
            self.rest.append(math.sqrt(max(0.0, total - float(squares[min(heavy, len(own)) - 1]))) if len(own) else 0.0)


class Best:
    """The best documents of one item so far, and the score that another must reach."""

    def __init__(self, k: int, least: int) -> None:
        self.k, self.least = k, max(1, least)
        self.ids, self.known, self.scores = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> None:
        self.ids, self.known, self.scores = np.r_[self.ids, ids], np.r_[self.known, known], np.r_[self.scores, scores]
        order = np.lexsort((self.ids, ~self.known, -self.scores))[: self.k]
        self.ids, self.known, self.scores = self.ids[order], self.known[order], self.scores[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


class Bucket:
    """Documents of similar norm, their coordinates by term."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, norms: np.ndarray, terms: np.ndarray, rows: np.ndarray, values: np.ndarray, n_terms: int) -> None:
        self.ids, self.known, self.norms = ids, known, norms
        order = np.argsort(terms, kind="stable")
        self.rows, self.values = rows[order], values[order]
        self.begin = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.greatest = np.zeros(n_terms, np.int64)
        full = np.flatnonzero(np.diff(self.begin))
        if len(full):
            self.greatest[full] = np.maximum.reduceat(self.values, self.begin[full])

    def coordinates(self, terms: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, values and weights of all coordinates of ``terms``."""
        begin, sizes = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        total = int(sizes.sum())
        at = np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(total)
        return self.rows[at], self.values[at], np.repeat(w, sizes)

    def survivors(self, items: Items, k: int, least: int) -> np.ndarray:
        """Documents that may reach ``least``, by their coordinates in the focus of item ``k`` and a bound on the others."""
        focus = items.focus[k]
        terms, w = items.terms[k], items.weights[k].astype(np.float64)
        rows, values, own = self.coordinates(terms[:focus], w[:focus])
        there = np.bincount(rows, values * own, len(self.ids))
        square = np.bincount(rows, values.astype(np.float64) ** 2, len(self.ids))
        by_norm = items.rest[k] * np.sqrt(np.maximum(self.norms**2 - square, 0.0))
        by_greatest = float((w[focus:] * self.greatest[terms[focus:]]).sum())
        # a little more than the bound, for what rounding takes away
        return (there + np.minimum(by_norm, by_greatest)) * (1 + 1e-9) + 1 >= least

    def search(self, items: Items, k: int, best: Best) -> None:
        maybe = self.survivors(items, k, best.least)
        if not maybe.any():
            return
        rows, values, own = self.coordinates(items.terms[k], items.weights[k])
        left = maybe[rows]
        scores = np.zeros(len(self.ids), np.int64)
        np.add.at(scores, rows[left], values[left] * own[left])
        found = np.flatnonzero(scores >= best.least)
        if len(found):
            best.add(self.ids[found], self.known[found], scores[found])


def buckets(ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int) -> Iterator[Bucket]:
    """Buckets of falling norm; ``sizes`` are the numbers of coordinates, which lie one document after the other."""
    rows = np.repeat(np.arange(len(ids)), sizes)
    norms = np.sqrt(np.bincount(rows, values.astype(np.float64) ** 2, len(ids)))
    by_norm = np.argsort(-norms, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by_norm] = np.arange(len(ids))
    order = np.argsort(place[rows], kind="stable")
    rows, terms, values = place[rows][order], terms[order], values[order]
    for begin in range(0, len(ids), BUCKET):
        some = by_norm[begin : begin + BUCKET]
        a, b = np.searchsorted(rows, [begin, begin + len(some)])
        yield Bucket(ids[some], known[some], norms[some], terms[a:b], rows[a:b] - begin, values[a:b], n_terms)


def best_of(vectors: DataFrame, items: Items, n_terms: int, documents: int, length: int, k: int, least: list[int]) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item, those of at least the item's ``least``."""

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, x) for x in least]
        held: list[tuple] = []

        def settle() -> None:
            ids, known, n, sizes, terms, times = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            values = impacts(times.astype(np.int64), n, sizes, documents, length)
            open_items = [i for i, own in enumerate(items.terms) if len(own)]
            for bucket in buckets(ids, known, sizes, terms, values, n_terms):
                open_items = [i for i in open_items if items.norms[i] * float(bucket.norms[0]) * (1 + 1e-9) + 1 >= best[i].least]
                for i in open_items:
                    bucket.search(items, i, best[i])

        size = 0
        for part in parts:
            ids, n, terms, times = (part.column(c) for c in range(4))
            sizes = np.diff(terms.offsets.to_numpy())
            held.append((
                ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), n.to_numpy(), sizes,
                terms.flatten().to_numpy(), times.flatten().to_numpy(),
            ))
            size += int(sizes.sum()) + len(ids)
            if size > HELD:
                settle()
                size = 0
        if held:
            settle()
        for i, found in enumerate(best):
            if len(found.ids):
                yield pa.record_batch([
                    pa.array(np.full(len(found.ids), i, np.int32)), pa.array(found.ids, mask=~found.known), pa.array(found.scores),
                ], names=["item", "doc_id", "score"])

    return vectors.select("doc_id", "n", "terms", "times").mapInArrow(search, HITS)


def top(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each item with their ``rank``, cut in salted groups before."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))
    nth = F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))
    some = hits.withColumn("salt", salt).withColumn("nth", nth).where(F.col("nth") <= k).drop("salt", "nth")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search_block(rows: DataFrame, item_ids: list[int | None], own_terms: list[list[str]], k: int) -> DataFrame:
    """The results of one block of items, written to the shared folder."""
    spark = rows.sparkSession
    terms = sorted({t for own in own_terms for t in own})
    number = {t: i for i, t in enumerate(terms)}
    vectors = written(counted_terms(rows, terms), "vectors")
    documents, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for term, holds in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the block's terms at most
        df[term] = holds
    weight = weights(df, documents)
    items = Items([np.array([number[t] for t in own], np.int64) for own in own_terms], weight)

    # the norm of the impacts, near enough to choose who goes first
    m = F.lit(50.0) + F.lit(50.0 * documents / max(1, length)) * F.col("n")
    norm = F.aggregate("times", F.lit(0.0), lambda s, x: s + F.pow(1e9 * x / (1000.0 * x + 20.0 * m), F.lit(2)))
    share = min(1.0, LEAD / max(1, documents))
    normed = vectors.withColumn("norm", norm)
    edge = normed.agg(F.percentile_approx("norm", 1.0 - share, 1000)).first()[0] or 0.0
    least = [1] * len(item_ids)
    lead = written(top(best_of(normed.where(F.col("norm") >= edge), items, len(terms), documents, length, k, least), k), "lead")
    for item, score in lead.where(F.col("rank") == k).select("item", "score").collect():  # one row per item of the block
        least[item] = score
    rest = best_of(normed.where(F.col("norm") < edge), items, len(terms), documents, length, k, least)
    names = spark.createDataFrame(list(enumerate(item_ids)), "item int, item_id long")
    ranked = top(rest.unionByName(lead.drop("rank")), k)
    return written(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score; only scores above 0."""
    spark = docs.sparkSession
    asked = written(item_terms(items, item_id, item_text), "items")
    blocks = math.ceil(asked.count() / block_terms)
    rows = plain(docs, id_col, text_col)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        found = mine.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item_id").collect()
        if found:
            out = out.unionByName(search_block(rows, [r[0] for r in found], [r[1] for r in found], k))
    return out
