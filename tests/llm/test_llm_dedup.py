"""Deduplication operators against plain Python over small odd tables."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SCHEMA, table

from wardlight.llm import exact_dedup, line_dedup, simhash, suffix_dedup
from wardlight.llm.common import merged
from wardlight.llm.queries import QUERIES


def unique(rows):
    """Rows that repeat id and text once; a null text as an empty one."""
    return sorted({(i, t or "") for i, t, _ in rows}, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))


def signed(text):
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64))


# Lines.

def lines_by_hand(rows):
    first, gone = {}, defaultdict(set)
    for row in unique(rows):
        parts = row[1].split("\n")
        for p in range(len(parts) - 2):
            key = tuple(parts[p : p + 3])
            if first.setdefault(key, (row, p)) != (row, p):
                gone[row] |= {p, p + 1, p + 2}
    return {r: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[r]) for r in unique(rows)}


def test_line_dedup(spark, odd, odd_rows):
    want = lines_by_hand(odd_rows)
    got = line_dedup.line_dedup(odd)
    assert got.columns == odd.columns
    rows = [(r.doc_id, r.text, r.source) for r in got.collect()]
    assert Counter(rows) == Counter((i, None if t is None else want[i, t], "s") for i, t, _ in odd_rows)
    counts = line_dedup.line_cuts(odd).select("cut.n_lines", "cut.n_removed").agg({"n_lines": "sum", "n_removed": "sum"}).first()
    assert counts["sum(n_lines)"] == sum((t or "").count("\n") + 1 for _, t, _ in odd_rows)
    assert next(want[i, t] for i, t, _ in odd_rows if i == 160) == "hot line"


def test_line_dedup_keeps_clashing_columns(clash):
    got = line_dedup.line_dedup(clash)
    assert got.columns == clash.columns and got.count() == clash.count()


# Exact copies.

def test_exact_dedup(odd, odd_rows):
    groups = defaultdict(list)
    for i, t, _ in odd_rows:
        groups[t or ""].append(i)
    got = exact_dedup.exact_dedup(odd, owned=8).collect()
    assert len(got) == len(odd_rows)
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    for text, ids in groups.items():
        own = by_text[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert Counter(r.doc_id for r in own) == Counter(ids)
        assert {r.keep_id for r in own} == {max(known) if known else None} and {r.group_size for r in own} == {len(ids)}
        assert [r.doc_id for r in own if r.kept] == [max(known) if known else None]


@pytest.mark.parametrize("n", [1, 2, 3, 100, 5000])
def test_golomb_round_trip(n):
    rng = np.random.default_rng(n)
    values = np.unique(np.r_[rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2), np.uint64(2**64 - 1)][:n])
    for v in (values, np.arange(n, dtype=np.uint64) + np.uint64(7)):
        k, first, quotients, rests = exact_dedup.encode(v)
        assert (exact_dedup.decode(len(v), k, first, quotients, rests) == v).all()


def test_colliding_fingerprints_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(3).cast("long"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(rows).collect()} == {(1, 3, False), (2, 2, True), (3, 3, True)}


# SimHash.

def fingerprint_by_hand(text, n=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(values, bits):
    """Least index of each value's component."""
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_simhash_groups(odd, odd_rows):
    rows = unique(odd_rows)
    fps = [fingerprint_by_hand(t) for _, t in rows]
    root = groups_by_hand(fps, 3)
    ids = defaultdict(list)
    for (i, _), r in zip(rows, root, strict=True):
        ids[r].append(i)
    least = {r: min([i for i in own if i is not None], default=None) for r, own in ids.items()}
    want = {(i, signed(t)): (f, least[r]) for (i, t), f, r in zip(rows, fps, root, strict=True)}
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert (r.fp & (1 << 64) - 1, r.component_id) == want[r.doc_id, r.text_key]
    stays = {(r.doc_id, r.text_key) for r in got if r.stays}
    assert len(stays) == len(ids)


def test_long_text_fingerprint():
    text = " ".join(map(str, range(150_000)))
    assert simhash.fingerprint(text.encode()) == fingerprint_by_hand(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_lose_no_link(spark, monkeypatch, seed):
    """Clusters, chains and noise, with shards and leaves so small that trees are deep."""
    monkeypatch.setattr(simhash, "SHARD", 40)
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(700)}
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(2, 30)):
            values.add(v)
            for _ in range(rng.randint(1, 3)):
                v ^= 1 << rng.randint(0, 63)
    values = sorted(values, key=lambda v: int(np.uint64(v).view(np.int64)))
    rows = [(int(np.uint64(v).view(np.int64)),) for v in values]
    found = simhash.stars(simhash.links(spark.createDataFrame(rows, "fp long"))).collect()
    got = {r.fp: r.root for r in found}
    want = groups_by_hand(values, 3)
    assert {rows[k][0]: rows[r][0] for k, r in enumerate(want) if r != k} == got


def around(rng, n, flips):
    """Distinct fingerprints that differ from one value in some of their bits."""
    out = np.full(n, np.uint64(0x123456789ABCDEF0))
    for _ in range(flips):
        out ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(out)


@pytest.mark.parametrize("flips,small,bits", [(3, 4, 3), (4, 4, 3), (5, 64, 3), (5, 4, 2), (8, 512, 3), (4, 16, 4), (3, 8, 0)])
def test_dense_fingerprints_lose_no_link(flips, small, bits):
    fps = around(np.random.default_rng(flips), 1500, flips)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits)
    assert (simhash.dense_components(fps, bits, small) == simhash.components(len(fps), a, b)).all()


def test_dense_shards_take_linear_time():
    """200,000 fingerprints around one value; all pairs would take some minutes."""
    fps, began = around(np.random.default_rng(7), 200_000, 6), time.time()
    both = [simhash.shard_links(fps, which, 3) for which in (0, 1)]
    assert time.time() - began < 180
    a, b = (np.searchsorted(fps, np.concatenate(c)) for c in zip(*both, strict=True))
    label = simhash.components(len(fps), a, b)
    for k in np.random.default_rng(8).choice(len(fps), 300, replace=False).tolist():
        near = label[np.bitwise_count(fps ^ fps[k]) <= 3]
        assert (near == label[k]).all()


# Suffix arrays.

def windows_by_hand(texts, length):
    count = Counter(d[i : i + length] for d in texts for i in range(len(d) - length + 1))
    return [[i for i in range(len(d) - length + 1) if count[d[i : i + length]] > 1] for d in texts]


@pytest.mark.parametrize("cap", [4096, 2, 0])
def test_suffix_dedup(odd, odd_rows, cap):
    """At each cap: all by the scan, large anchors by counting windows, all by counting."""
    rows = unique(odd_rows)
    want = {}
    texts = [t.encode() for _, t in rows]
    for (i, t), raw, starts in zip(rows, texts, windows_by_hand(texts, 60), strict=True):
        covered = sorted({k + d for k in starts for d in range(60)})
        runs = sum(1 for k, p in enumerate(covered) if not k or covered[k - 1] != p - 1)
        gone = set(covered)
        want[i, t] = (len(raw), len(covered), runs, bytes(b for k, b in enumerate(raw) if k not in gone))
    got = suffix_dedup.suffix_dedup(odd, length=60, gram=20, cap=cap)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == Counter(
        (i, *want[i, t or ""]) for i, t, _ in odd_rows)


def test_suffix_query_takes_400_bytes(spark, tmp_path):
    """The contract's length to the byte: a shared passage of 51 words or of 399 bytes stays, one of 400 goes."""
    rng = random.Random(11)

    def noise(n):
        return "".join(rng.choice("abcdefghij ") for _ in range(n))

    words = " ".join(noise(5).replace(" ", "k") for _ in range(51))
    rows, want = [], {}
    for k, shared in enumerate((words, noise(399), noise(400))):
        for i in (10 * k, 10 * k + 1):
            # other bytes on both sides, or the string would be longer
            left, right = noise(70) + "yz"[i % 2], "YZ"[i % 2] + noise(70)
            rows.append((i, left + shared + right, "en"))
            gone = 400 if len(shared) == 400 else 0
            kept = left + right if gone else left + shared + right
            want[i] = (len(rows[-1][1]), gone, int(gone > 0), hashlib.sha256(kept.encode()).hexdigest(), len(kept))
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op3_suffix_dedup"](spark, str(tmp_path))
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_scan_on_random_texts():
    rng = random.Random(5)
    for trial in range(150):
        length, gram = rng.choice([(6, 2), (10, 3), (20, 5), (40, 10)])
        letters = b"ab" if trial % 3 else b"abcdefgh"
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(4)]
        texts = [b"".join(rng.choice(base)[: rng.randint(1, 60)] + bytes(rng.choice(letters) for _ in range(rng.randint(0, 8)))
                          for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 12))]
        texts.append(b"a" * rng.randint(0, 100))
        times, stretch, by_anchor, found = Counter(), {}, defaultdict(set), []
        for k, d in enumerate(texts):
            for a, c1, c2, lo, hi, off, size, n in suffix_dedup.occurrences(d, length, gram) if len(d) >= length else []:
                times[a, c1, c2] += n
                stretch[a, c1, c2] = (d[lo : lo + size], off)
                by_anchor[a].add((c1, c2))
                found.append((k, (a, c1, c2), lo, hi))
        keys = [s for s in stretch if len(by_anchor[s[0]]) > 1]
        windows = defaultdict(list)
        if keys:
            for i, first, last in suffix_dedup.scan(np.array([s[0] for s in keys]), np.array([stretch[s][1] for s in keys]), [stretch[s][0] for s in keys], length):
                windows[keys[i]] += range(first, last + 1)
        got = [set() for _ in texts]
        for k, key, lo, hi in found:
            got[k] |= set(range(lo, hi + 1)) if times[key] > 1 else {lo + w for w in windows[key]}
        assert [sorted(g) for g in got] == windows_by_hand(texts, length)


def test_anchors_across_segments(monkeypatch):
    """Segments change nothing: equal windows have equal anchors wherever they lie."""
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 500)
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 110, 900, dtype=np.uint8).tobytes()
    raw = rng.integers(97, 110, 730, dtype=np.uint8).tobytes() + passage + b"-" * 77 + passage
    places = [o for o in suffix_dedup.occurrences(raw, 400, 100)]
    covered = sorted(x for o in places for x in range(o[3], o[4] + 1))
    assert covered == list(range(len(raw) - 399))
    assert {o[0] for o in places if 730 <= o[3] and o[4] <= 730 + 500} <= {o[0] for o in places if o[3] >= 730 + 977}


def test_merged():
    starts, ends = merged(np.array([5, 0, 2, 20]), np.array([9, 3, 5, 21]))
    assert list(zip(starts, ends, strict=True)) == [(0, 9), (20, 21)]


def test_texts_without_repeats(odd, odd_rows, clash):
    got = suffix_dedup.without_repeats(odd, length=60, gram=20)
    assert got.columns == odd.columns and got.count() == len(odd_rows)
    assert [r.text for r in got.where("doc_id = 140").collect()] == [None]
    assert [r.text for r in got.where("doc_id = 132").collect()] == [""]
    assert suffix_dedup.without_repeats(clash).columns == clash.columns


@pytest.mark.parametrize("operator", [
    line_dedup.line_dedup, exact_dedup.exact_dedup, simhash.simhash_groups, suffix_dedup.suffix_dedup, suffix_dedup.without_repeats,
])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
