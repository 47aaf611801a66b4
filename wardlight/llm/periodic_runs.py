"""Periodic runs of words: stretches that repeat a period, found by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q and a length of at
least ``max(least, 2 * q)`` that no neighbouring word extends keeping the period.

Method.  The suffixes of each document are sorted by prefix doubling (only those
still tied are sorted again), which gives the suffix array and its inverse.  A
stack-scan of the common prefixes of neighbours finds, for every place where two
neighbours part, the interval around it; there are no tree nodes.  With d the
common length there, each suffix i of the smaller side is asked, through the
inverse array, whether i + d or i - d lies on the other side.  If so, the two are
equal for exactly d words: a square of period d that branches, that is, one that
its next word does not continue.  Every run ends with one such square.  The square
is rotated to the left as far as the period holds, and squares that end at the
same word are merged into one run of the smallest period.

Shallow intervals are not needed: a run of period q and length ``least`` or more
also ends with a square of period k * q, and some such multiple is at least
``shallowest(least)`` (4 for the default 12).  Common words and phrases shorter
than that never enter the scan.

Memory: documents are sorted together up to ``TOGETHER`` words at a time; a longer
one is sorted alone, with some arrays of its length.  Work is narrow: no shuffle.

Nulls and edges: words are the maximal stretches of anything but ASCII white space;
a null or empty text has no words and no runs; null ids and repeated rows are
answered row by row; ties are settled by least start, then least period; an empty
table gives an empty one; only id and text are read, so further columns cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import plain, sliced, text_bytes

LEAST = 12
TOGETHER = 1 << 18  # words sorted together
_PROBES = 1 << 20  # members asked at a time

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def shallowest(least: int) -> int:
    """The least depth at which every run shows, as a square of its period or of a multiple."""
    return min(max(q, least // (2 * q) * q) for q in range(1, least + 1))


def suffix_order(words: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array and inverse; the places of the array whose suffixes share ``depth`` words or more with another, and their groups.

    ``words`` are numbers that differ between documents, ``ends`` the end of each
    word's document; ``depth`` is a power of two.
    """
    n = len(words)
    order = np.argsort(words)
    keys = words[order]
    ranks = np.empty(n, np.int64)  # place of the group's first member, plus 1; 0 is beyond the end
    active, step = np.arange(n), 1
    members = order
    deep = groups = np.empty(0, np.int64)
    while len(active):
        new = np.r_[True, keys[1:] != keys[:-1]]
        first = np.maximum.accumulate(np.where(new, active, 0))
        order[active] = members
        ranks[members] = first + 1
        tied = ~(new & np.r_[new[1:], True])
        active, first = active[tied], first[tied]
        if step == depth:
            deep, groups = active, first
        members = order[active]
        after = members + step
        following = np.where(after < ends[members], ranks[np.minimum(after, n - 1)], 0)
        keys = ranks[members] * np.int64(n + 2) + following
        by_key = np.argsort(keys)
        members, keys, step = members[by_key], keys[by_key], 2 * step
    return order, ranks - 1, deep, groups


def common_prefixes(words: np.ndarray, ends: np.ndarray, order: np.ndarray, deep: np.ndarray, groups: np.ndarray, depth: int) -> np.ndarray:
    """Common length with the member before, for the places ``deep`` of the suffix array; 0 for the first of a group.

    Found in the order of the text: what suffix i shares with its neighbour,
    suffix i + 1 shares but for one word.
    """
    lcp = np.zeros(len(deep), np.int64)
    inner = np.flatnonzero(np.r_[False, groups[1:] == groups[:-1]]) if len(deep) else deep
    members, before = order[deep[inner]], order[deep[inner] - 1]
    in_text = np.argsort(members)
    found, known, last = [], 0, 0
    text = words.tolist()
    rows = zip(members[in_text].tolist(), before[in_text].tolist(), ends[members[in_text]].tolist(), strict=True)
    for i, j, end in rows:
        known = max(depth, known - (i - last))
        last, room = i, end - max(i, j)
        while known < room and text[i + known] == text[j + known]:
            known += 1
        found.append(known)
    lcp[inner[in_text]] = found
    return lcp


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, first, after) by a stack-scan: at a place p, members first..p-1 part from members p..after-1 after exactly lcp[p] words."""
    heights = lcp.tolist()
    first, after = [0] * len(heights), [len(heights)] * len(heights)
    stack: list[int] = []
    for k, height in enumerate(heights):
        while stack and heights[stack[-1]] > height:
            after[stack.pop()] = k
        if height:
            first[k] = stack[-1] if stack else 0
        else:
            stack.clear()
        stack.append(k)
    places = np.flatnonzero(lcp)
    return places, np.array(first, np.int64)[places], np.array(after, np.int64)[places]


def branching_squares(
    order: np.ndarray, deep: np.ndarray, lcp: np.ndarray, begins: np.ndarray, ends: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Ends and periods of the squares that branch, by asking the members of each interval's smaller side."""
    inverse = np.full(len(order), -1, np.int64)  # place among the deep ones
    inverse[order[deep]] = np.arange(len(deep))
    places, first, after = intervals(lcp)
    left_small = places - first <= after - places
    small = np.where(left_small, first, places)
    sizes = np.where(left_small, places, after) - small
    other, other_end = np.where(left_small, places, first), np.where(left_small, after, places)
    depths, totals = lcp[places], np.cumsum(sizes)
    found_ends, found_periods = [], []
    begin = 0
    while begin < len(places):
        done = totals[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(totals, done + _PROBES, side="right")))
        part = slice(begin, end)
        which = np.repeat(np.arange(begin, end), sizes[part])
        member = small[which] + np.arange(len(which)) - np.repeat(totals[part] - sizes[part] - done, sizes[part])
        i, d = order[deep[member]], depths[which]
        for partner, inside in ((i + d, i + d < ends[i]), (i - d, i - d >= begins[i])):
            at = np.flatnonzero(inside)
            place = inverse[partner[at]]
            at = at[(place >= other[which[at]]) & (place < other_end[which[at]])]
            found_ends.append(np.minimum(i[at], partner[at]) + 2 * d[at])
            found_periods.append(d[at])
        begin = end
    return np.concatenate([*found_ends, deep[:0]]), np.concatenate([*found_periods, deep[:0]])


def kept_back(words: np.ndarray, begin: int, end: int, period: int) -> int:
    """How many words before ``end``, none before ``begin``, keep the period: the square rotated left as far as it goes."""
    count, step = 0, 32
    while True:
        low = max(begin, end - period - count - step)
        here = words[low : end - period - count]
        differ = np.flatnonzero(here != words[low + period : end - count])
        if len(differ):
            return count + len(here) - 1 - int(differ[-1]) + period
        count += len(here)
        if low == begin:
            return count + period
        step *= 4


def merged_runs(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, tails: np.ndarray, periods: np.ndarray, least: int, depth: int) -> list[tuple[int, int, int]]:
    """(end, length, period) of the runs whose last squares end at ``tails``: of squares with one end the smallest period counts."""
    out: list[tuple[int, int, int]] = []
    keys = np.unique(tails * np.int64(len(words) + 1) + periods)
    tails, periods = keys // (len(words) + 1), keys % (len(words) + 1)
    bounds = np.flatnonzero(np.r_[True, tails[1:] != tails[:-1], True]) if len(tails) else np.zeros(1, int)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        end, covered = int(tails[a]), 0
        begin, limit = int(begins[end - 1]), int(ends[end - 1])
        for period in [*range(1, depth), *periods[a:b].tolist()]:
            if covered >= 2 * period or end - begin < max(least, 2 * period):
                continue  # a multiple of a period that was kept
            if words[end - 1] != words[end - 1 - period] or (end < limit and words[end] == words[end - period]):
                continue
            length = kept_back(words, begin, end, period)
            if length >= max(least, 2 * period):
                out.append((end, length, period))
                covered = max(covered, length)
    return out


def runs_of(documents: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start and then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    if not sizes.sum():
        return out
    spelled = pa.array([w for d in documents for w in d], pa.large_binary()).dictionary_encode()
    numbers = spelled.indices.to_numpy().astype(np.int64)
    after = np.cumsum(sizes)
    which = np.repeat(np.arange(len(documents)), sizes)
    begins, ends = np.repeat(after - sizes, sizes), np.repeat(after, sizes)
    depth = 1 << (shallowest(least).bit_length() - 1)
    order, _, deep, groups = suffix_order(which * len(spelled.dictionary) + numbers, ends, depth)
    if not len(deep):
        return out
    lcp = common_prefixes(numbers, ends, order, deep, groups, depth)
    tails, periods = branching_squares(order, deep, lcp, begins, ends)
    for end, length, period in merged_runs(numbers, begins, ends, tails, periods, least, depth):
        k = int(which[end - 1])
        out[k].append((end - length - int(after[k] - sizes[k]), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, each run cut to its first period."""
    if not found:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        cover[start + period] += 1
        cover[start + length] -= 1
    stays = np.cumsum(cover)[:-1] == 0
    return b" ".join([words[i] for i in np.flatnonzero(stays).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row ``doc_id``, ``runs`` (by start and period) and ``collapsed``, the words with every run cut to its first period."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("runs", kind), ("collapsed", pa.string())])

    def answer(ids: list, documents: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(documents, least)
        kept = pa.array([collapsed(d, f) for d, f in zip(documents, found, strict=True)], pa.binary())
        runs = [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(runs, kind), kept.cast(pa.string())], schema=schema)

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, documents, held = [], [], 0
        for part in sliced(parts):
            for doc, raw in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True):
                words = raw.split()  # of bytes: ASCII white space only
                if documents and held + len(words) > TOGETHER:
                    yield answer(ids, documents)
                    ids, documents, held = [], [], 0
                ids.append(doc)
                documents.append(words)
                held += len(words)
        if documents:
            yield answer(ids, documents)

    return plain(docs, id_col, text_col).mapInArrow(find, f"doc_id long, runs {RUNS}, collapsed string")


def longest(runs: Column) -> Column:
    """The longest run; of equals the one of least start, then least period; null without runs."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("key"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ranked)


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run, and hashes of the list of runs and of the collapsed words."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", longest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of which some, by a hash of their ids, have a periodic end: the rows that the query judges.

    With h the CRC-32 of the decimal id and g = h div 10, of documents with h mod 10
    = 0 and n > 0 words each word i >= a becomes word a + (i - a) mod p, where a = g
    mod n and p = 1 + (n - a) div (3 + g mod 8).
    """
    rows = plain(docs, id_col, text_col).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)")))
    shaped = words.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10")).withColumn(
        "a", F.expr("if(n > 0, cast(g % n as int), 0)")
    ).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    planted = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[a + (i - a) % p])), ' ')")
    return shaped.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
