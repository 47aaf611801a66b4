"""SimHash near-dedup: fingerprints linked by vantage-point trees over shards.

A text's words (A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``) make shingles; a bit of
the 64-bit fingerprint is 1 if it is set in over half the shingles' XXH64 hashes.
Fingerprints that differ in at most ``max_bits`` bits are linked, and documents
are grouped by the components of these links.

Search.  Two fingerprints within ``max_bits`` agree within ``max_bits // 2`` bits
in one of their 32-bit halves.  So each half has its own vantage-point tree, with
that smaller radius r.  A node has a vantage point and a cut; a fingerprint goes
to the inner side if its distance is at most the cut, and to the outer side if
its distance plus r is beyond the cut: by the triangle inequality nothing within
r of it lies on a side it does not visit.  Only fingerprints at the boundary
visit both.  The top of the tree comes from a bounded sample and deals the
fingerprints to shards; each shard continues the tree over all its own
fingerprints and compares whole fingerprints in the leaves, so no pair is missed.
A node that no vantage point cuts (very many fingerprints around one value) is
linked by equal bytes and flipped bits instead (``dense_components``).

Copies cost nothing: equal fingerprints are one before the search.  A shard
gives one link per fingerprint (to the least of its component there), never all
pairs, and components are joined in rounds of two aggregates, each written to
the shared folder.

Nulls and edges: a null or empty text has no words and fingerprint 0, linked like
any other; fewer words than a shingle make one shingle of what there is; null ids
are passed over for ``component_id`` unless a group has no other; rows that
repeat id and text are one row; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import KEY, drawn, sliced, text_bytes, with_key
from wardlight.session import written

SHINGLE = 3
MAX_BITS = 3
SEED = 42

SAMPLE = 1 << 16  # fingerprints, at most, that the top of the trees is made from
SHARD = 20_000  # fingerprints a shard should have before boundary visits
NODE_SAMPLE = 16  # fewest sampled fingerprints a node of the top is cut by
LEAF = 512  # fingerprints compared pairwise at the foot of a tree
DENSE_BITS = 4  # up to which a dense node is linked by equal bytes
HELD = 1 << 20  # links kept before components are brought up to date


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65_536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_key`` and the fingerprint as a signed long, for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            fps = np.array([fingerprint(t, shingle) for t in text_bytes(part.column(1))], np.uint64)
            yield pa.record_batch([part.column(0), part.column(2), pa.array(fps.view(np.int64))], schema=schema)

    return with_key(docs, id_col, text_col).select("doc_id", "text", "text_key").mapInArrow(hashed, "doc_id long, text_key long, fp long")


# Trees.

def half(fps: np.ndarray, which: int) -> np.ndarray:
    return (fps >> np.uint64(32 * which)).astype(np.uint32)


def best_cut(points: np.ndarray, radius: int) -> tuple[int, int] | None:
    """Vantage point and cut for the least work below; None if no cut saves a tenth of comparing all with all."""
    best, most = None, 0.9 * float(len(points)) ** 2
    for vantage in points[np.linspace(0, len(points) - 1, 8).astype(int)].tolist():
        counts = np.bincount(np.bitwise_count(points ^ np.uint32(vantage)), minlength=33).cumsum()
        cut = int(np.searchsorted(counts, len(points) / 2))
        for c in (cut - 1, cut):
            if c < 0:
                continue
            inner, outer = counts[c], len(points) - (counts[c - radius] if c >= radius else 0)
            cost = float(inner) ** 2 + float(outer) ** 2
            if cost < most:
                best = min(best or (cost, vantage, c), (cost, vantage, c))
    return best and best[1:]


def top_tree(sample: np.ndarray, depth: int, radius: int) -> dict[int, tuple[int, int]]:
    """Nodes by number (root 1, sides 2n and 2n+1) down to ``depth`` levels."""
    tree, todo = {}, [(1, sample)]
    while todo:
        node, points = todo.pop()
        if node >= 1 << depth or len(points) < NODE_SAMPLE or (found := best_cut(points, radius)) is None:
            continue
        tree[node] = found
        inner, outer = sides(points, found, radius)
        todo += [(2 * node, points[inner]), (2 * node + 1, points[outer])]
    return tree


def sides(points: np.ndarray, node: tuple[int, int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points visit the inner and the outer side."""
    distance = np.bitwise_count(points ^ np.uint32(node[0])).astype(np.int16)
    return distance <= node[1], distance + radius > node[1]


def shards_of(tree: dict[int, tuple[int, int]], points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard number and the places of the points that visit it."""
    todo = [(1, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if node in tree:
            inner, outer = sides(points[at], tree[node], radius)
            todo += [(2 * node, at[inner]), (2 * node + 1, at[outer])]
        elif len(at):
            yield node, at


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each vertex's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        if not ((label[a] != least) | (label[b] != least)).any():
            return label
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]


def leaf_links(fps: np.ndarray, at: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the fingerprints at ``at``, by blocks; within a block one per component."""
    for i in range(0, len(at), LEAF):
        rows = at[i : i + LEAF]
        for j in range(i, len(at), LEAF):
            cols = at[j : j + LEAF]
            a, b = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[cols][None, :]) <= max_bits)
            if len(a) > (len(rows) if j == i else 0):  # a block with itself has its diagonal
                both = np.r_[rows, cols] if j > i else rows
                label = components(len(both), a, b + (len(rows) if j > i else 0))
                yield both, both[label]


class Linked:
    """Components of vertices as links come in, by the least member of each."""

    def __init__(self, n: int) -> None:
        self.label, self.held, self.size = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append((a, b))
            self.size += len(a)
            if self.size > HELD:
                self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        a, b = (self.label[np.concatenate(c)] for c in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        apart = a != b
        if apart.any():
            self.label = components(len(self.label), a[apart], b[apart])[self.label]

    def is_one(self, members: np.ndarray) -> bool:
        labels = self.label[members]
        return bool((labels == labels[0]).all())


def link_by_flips(fps: np.ndarray, members: np.ndarray, free: int, max_bits: int, linked: Linked) -> None:
    """Link members that differ in bits of ``free`` alone, by looking up what each becomes with some of these bits flipped."""
    members = members[np.argsort(fps[members])]
    own, bits = fps[members], [1 << b for b in range(64) if free >> b & 1]
    for n in range(1, max_bits + 1):
        linked.settle()
        if linked.is_one(members):
            return
        for flipped in combinations(bits, n):
            other = own ^ np.uint64(sum(flipped))
            place = np.minimum(np.searchsorted(own, other), len(own) - 1)
            hit = np.flatnonzero((own[place] == other) & (other > own))
            linked.add(members[hit], members[place[hit]])


def dense_components(fps: np.ndarray, max_bits: int, small: int = LEAF) -> np.ndarray:
    """Components of fingerprints that lie too near each other for a vantage point to part them.

    Two within ``max_bits`` are equal in all but ``max_bits`` of their eight bytes.  For
    each choice of bytes, those that agree in them are compared, or, where they are
    many, looked up by flipped bits unless they are one component already.  So the
    work grows with the fingerprints and not with their square.
    """
    linked = Linked(len(fps))
    for kept in combinations(range(8), 8 - max_bits):
        mask = sum(0xFF << (8 * b) for b in kept)
        keys = fps & np.uint64(mask)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[first, len(keys)])
        large = sizes > small
        group = np.repeat(np.where(large, -1, np.arange(len(first))), sizes)
        left, step = np.flatnonzero(group >= 0), 1
        while len(left):  # neighbours at growing distance, while they are of one group
            left = left[left + step < len(keys)]
            left = left[group[left] == group[left + step]]
            a, b = order[left], order[left + step]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
            linked.add(a[near], b[near])
            step += 1
        for k in np.flatnonzero(large).tolist():
            link_by_flips(fps, order[first[k] : first[k] + sizes[k]], ~mask & (1 << 64) - 1, max_bits, linked)
    linked.settle()
    return linked.label


def shard_links(fps: np.ndarray, which: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint of a shard and the least of its component in the shard."""
    radius, points = max_bits // 2, half(fps, which)
    found, todo = [], [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        cut = best_cut(points[at], radius) if len(at) > LEAF else None
        if cut is None and len(at) > LEAF and max_bits <= DENSE_BITS:
            found.append((at, at[dense_components(fps[at], max_bits)]))
            continue
        if cut is None:
            found += leaf_links(fps, at, max_bits)
            continue
        inner, outer = sides(points[at], cut, radius)
        todo += [at[inner], at[outer]]
    if not found:
        return fps[:0], fps[:0]
    label = components(len(fps), np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp``: enough that components are those of all pairs within ``max_bits``."""
    radius = max_bits // 2
    total = distinct.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / SHARD)))
    trees: list[dict[int, tuple[int, int]]] = [{}, {}]
    if depth:
        rank = F.xxhash64("fp")
        sample = distinct.select("fp").where(drawn(rank, total, SAMPLE)).orderBy(rank, "fp").limit(SAMPLE).collect()
        points = np.array([r[0] for r in sample], np.int64).view(np.uint64)
        trees = [top_tree(half(points, w), depth, radius) for w in (0, 1)]
    schema = pa.schema([("half", pa.int32()), ("shard", pa.int64()), ("fp", pa.int64())])

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for which in (0, 1):
                for shard, at in shards_of(trees[which], half(fps, which), radius):
                    yield pa.record_batch([
                        pa.array(np.full(len(at), which, np.int32)), pa.array(np.full(len(at), shard, np.int64)),
                        pa.array(fps[at].view(np.int64)),
                    ], schema=schema)

    def link(table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        u, v = shard_links(fps, table.column("half")[0].as_py(), max_bits)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "half int, shard long, fp long")
    return dealt.groupBy("half", "shard").applyInArrow(link, "u long, v long")


# Components.

def stars(edges: DataFrame) -> DataFrame:
    """(fp, root) for every linked vertex but the roots: the least vertex of its component.

    In a round every vertex links its greater neighbours to the least vertex it
    knows, and then its lesser ones.  A round's links, (greater, lesser), are
    written to the shared folder; the rounds end when one changes nothing.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))

    def greater_step(pairs: DataFrame) -> DataFrame:
        both = pairs.union(pairs.select("v", "u"))
        found = least(both).select("w", F.least("w", "m").alias("m"))
        return both.where("v > u").join(found, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def lesser_step(pairs: DataFrame) -> DataFrame:
        found = least(pairs)
        moved = pairs.join(found, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        return moved.union(found).distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    before = mark(pairs)
    while before[0]:
        pairs = written(lesser_step(greater_step(pairs)), "links")
        after = mark(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS,
) -> DataFrame:
    """Every row's ``doc_id``, ``text_key``, fingerprint ``fp``, ``component_id`` and whether it ``stays``.

    Of a group, the row of the least id stays (nulls last; then the least ``text_key``).
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), *KEY)).alias("first")
    distinct = written(rows.groupBy("fp").agg(first), "distinct")
    rooted = distinct.join(stars(links(distinct, max_bits)), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    by_fp = rooted.select("fp", "root").join(least, "root").select("fp", "least")
    return rows.join(by_fp, "fp").select(
        *KEY, "fp", F.col("least.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))).alias("stays"),
    )
