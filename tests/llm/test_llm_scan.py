"""License scans, lexical search and periodic runs against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SCHEMA, table

from wardlight.llm import lexical_search, license_scan, periodic_runs
from wardlight.llm.common import plain_words
from wardlight.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_by_hand(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def test_plain_words():
    text = "Ünï-CÖDE_x9 İ b\x1c日本\x00a\x7fB’s 1.5"
    assert [w.decode() for w in plain_words(text.encode())] == terms_by_hand(text)


# Periodic runs.

def runs_by_hand(words, least):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(least, 2 * q):
                part = words[s : s + n]
                if all(part[p:] != part[:-p] for p in range(1, q)):
                    out.append((s, n, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted_by_hand(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def random_documents(rng):
    for _ in range(rng.randint(1, 6)):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 5, 20])
        words = [b"%d" % rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        yield words


def test_runs_of_random_words():
    rng, long = random.Random(5), 0
    for _ in range(400):
        documents = list(random_documents(rng))
        for least in (12, rng.randint(2, 20)):
            want = [runs_by_hand(d, least) for d in documents]
            assert periodic_runs.runs_of(documents, least) == want
            long += sum(map(len, want))
    assert long > 1000


def test_shallowest_depth():
    assert [periodic_runs.shallowest(n) for n in (2, 3, 12)] == [1, 1, 4]


def test_runs_of_a_long_periodic_text():
    words = [b"a"] * 60_000 + [b"x"] + [b"%d" % (i % 977) for i in range(60_000)]
    got = periodic_runs.runs_of([words])[0]
    assert (0, 60_000, 1) in got and (60_001, 60_000, 977) in got and len(got) == 2


def check_runs(docs, rows):
    got = periodic_runs.periodic_runs(docs).collect()
    want = Counter()
    for doc_id, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = runs_by_hand(words, 12)
        want[doc_id, tuple(runs), collapsed_by_hand(words, runs)] += 1
    assert Counter((r.doc_id, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in got) == want


def test_periodic_runs_on_odd_rows(spark, odd, clash, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 5000]
    check_runs(table(spark, rows), rows)
    assert periodic_runs.periodic_runs(odd).count() == periodic_runs.periodic_runs(clash).count() == len(odd_rows)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_are_sorted_together_or_alone(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, b" ".join(d).decode(), None) for k in range(12) for d in random_documents(rng)]
    monkeypatch.setattr(periodic_runs, "TOGETHER", 50)
    documents = [r[1].encode().split() for r in rows]
    whole = periodic_runs.runs_of(documents)
    assert whole == [periodic_runs.runs_of([d])[0] for d in documents]
    check_runs(table(spark, rows), rows)


def test_periodic_query_by_hand(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert len(got) == len(docs)
    planted = 0
    for r in got:
        words = planted_by_hand(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or ""))
        if len(words) > 1500:
            continue
        runs = runs_by_hand(words, 12)
        planted += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed_by_hand(words, runs).encode()).hexdigest()
    assert planted > 5


# License scans.

def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(150):
        k = rng.choice([2, 3, 6])
        sequences = [[rng.randrange(k) for _ in range(rng.randint(2, 14))] for _ in range(rng.randint(1, 5))]
        automaton = license_scan.Automaton(sequences, 2)
        text = [rng.randrange(k + 1) for _ in range(50)]
        inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i, len(s) + 1)}
        for at, (state, length) in enumerate(automaton.statistics(text), 1):
            assert length == max(m for m in range(at + 1) if tuple(text[at - m : at]) in inside)
            if length >= 2:
                places = [(a, e) for a, s in enumerate(sequences) for e in range(length, len(s) + 1) if s[e - length : e] == text[at - length : at]]
                assert sorted(automaton.places[state]) == places


def share_by_hand(text, template):
    """The best chain's share of a template, over all fragments and without a window."""
    found = set()
    for i in range(len(text)):
        for j in range(len(template)):
            n = 0
            while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
                n += 1
            if n >= license_scan.LONG and not (i and j and text[i - 1] == template[j - 1]):
                found.add((i, j, n))
    covered = {}
    for at, there, n in sorted(found):
        covered[at, there, n] = n + max([0] + [
            c - max(0, a + m - at, t + m - there) for (a, t, m), c in covered.items()
            if a < at and t < there and a + m < at + n and t + m < there + n and at - a - m <= license_scan.GAP
        ])
    return max(covered.values(), default=0) / len(template)


def test_chains_of_disturbed_templates():
    rng = random.Random(4)
    template = [f"w{i}" for i in range(40)]
    scanner = license_scan.Scanner({}, [("own", " ".join(template))])
    for _ in range(200):
        text = []
        for w in template:
            if rng.random() < 0.95:
                text.append(w)
            if rng.random() < 0.08:
                text += ["noise"] * rng.randint(1, 14)
        text = ["before"] * rng.randint(0, 5) + text
        found = scanner.scan([[w.encode() for w in text]])[0]
        assert found["score"] == pytest.approx(share_by_hand(text, template))
        assert bool(found["spans"]) == (found["score"] >= license_scan.SHARE)
        for s in found["spans"]:
            assert 0 <= s["first_word"] < s["after_word"] <= len(text)


def test_every_template_finds_itself():
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES)
    for label, text in license_scan.TEMPLATES:
        words = plain_words(f"some words first {text}. And some after".encode())
        assert {"first_word": 3, "after_word": len(words) - 3, "label": label, "share": 1.0} in scanner.scan([words])[0]["spans"]
    many = plain_words(" x ".join([license_scan.TEMPLATES[0][1]] * 3000).encode())
    found = scanner.scan([many])[0]
    assert len(found["spans"]) == len(found["places"]) == 3000


def test_wrong_templates_are_refused():
    with pytest.raises(ValueError):
        license_scan.Scanner({}, [("x", "too short")])
    with pytest.raises(ValueError):
        license_scan.Scanner({"one": "x"}, [])


def places_by_hand(text):
    words = terms_by_hand(text)
    places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return words, places


def check_licenses(rows, texts):
    for r, text in zip(rows, texts, strict=True):
        words, places = places_by_hand(text)
        at = [p for p, _ in places]
        base = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(base) and 0 <= r.score <= 1
        shares = [(share_by_hand(words, terms_by_hand(t)), label) for label, t in license_scan.TEMPLATES]
        assert r.score == pytest.approx(max(s for s, _ in shares))
        assert r.labels == ",".join(sorted({*base, *[label for s, label in shares if s >= license_scan.SHARE]}))


def test_license_scan_on_odd_rows(spark, odd_rows):
    lines = ["Licensed under CC BY-NC 4.0. the APACHE license; mit\nlicense", "cc by cc by", "GNU General Public Licenses", "gnu-general.public_license"]
    rows = [(i, t, "en") for i, t, _ in odd_rows if len(t or "") < 3000] + [(900 + k, t, "en") for k, t in enumerate(lines)] + [(900, lines[0], "en")]
    docs = table(spark, rows).coalesce(1)
    check_licenses(license_scan.digests(license_scan.license_scan(docs)).collect(), [r[1] for r in rows])


def test_license_scan_with_clashes_and_empty(spark, odd, clash, odd_rows):
    assert license_scan.license_scan(clash).count() == license_scan.license_scan(odd).count() == len(odd_rows)
    assert license_scan.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_query_by_hand(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_license_scan"](spark, SF).collect()
    assert len(got) == len(docs) and any(r.base_labels for r in got)
    some = [r for r in got if r.n_words < 400 or r.n_base]
    check_licenses(some, [docs[r.doc_id] for r in some])


# Lexical search.

def ranking_by_hand(docs, items, k):
    counts = [(i, Counter(terms_by_hand(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    total, df = sum(n for _, _, n in counts), Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_by_hand(text))
    out = Counter()
    for item, terms in asked.items():
        scores = []
        for doc_id, c, n in counts:
            m = 50 + 50 * n * len(counts) // total
            s = sum(
                math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c
            )
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id))
        for rank, (s, _, _, doc_id) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, doc_id, -s] += 1
    return out


def answer(docs, items, **more):
    return Counter(tuple(r) for r in lexical_search.lexical_search(docs, items, **more).collect())


ITEMS = [(0, "hot line"), (1, "The Same  other text, id"), (2, None), (3, ""), (4, "nowhere"), (None, "one"), (5, "one"), (5, "hot")]


@pytest.mark.parametrize("lead", [1, 5, 4096])
def test_lexical_search_on_odd_rows(spark, odd_rows, clash, lead, monkeypatch):
    monkeypatch.setattr(lexical_search, "LEAD", lead)
    monkeypatch.setattr(lexical_search, "BUCKET", 7)
    asked = ITEMS + [(10 + k, r[1][:300]) for k, r in enumerate(odd_rows) if r[1] and k % 5 == 0]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumnRenamed("text", "question")
    want = ranking_by_hand([r[:2] for r in odd_rows], asked, 6)
    assert answer(clash, items, k=6, item_text="question") == want
    assert answer(clash, items, k=6, item_text="question", block_terms=100) == want


def test_lexical_search_of_nothing(spark, odd):
    items, none = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert answer(spark.createDataFrame([], SCHEMA), items) == answer(odd, none) == Counter()


def test_pruning_loses_nothing_and_prunes(monkeypatch):
    """Buckets and coordinates against scores of all documents, at many thresholds."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(lexical_search, "BUCKET", 50)
    terms, n_docs = 60, 1000
    weight = rng.integers(0, 9000, terms)
    held = [np.flatnonzero(rng.random(terms) < rng.choice([0.02, 0.1, 0.5])) for _ in range(n_docs)]
    values = [rng.integers(1000, 900_000, len(h)) for h in held]
    items = lexical_search.Items([np.flatnonzero(rng.random(terms) < 0.2) for _ in range(20)], weight)
    sizes = np.array([len(h) for h in held])
    made = list(lexical_search.buckets(np.arange(n_docs), np.ones(n_docs, bool), sizes, np.concatenate(held), np.concatenate(values), terms))
    assert sum(len(b.ids) for b in made) == n_docs
    scored = pruned = 0
    for i, own in enumerate(items.terms):
        wanted = set(own.tolist())
        scores = sorted(((-sum(int(weight[t]) * int(v) for t, v in zip(h, x, strict=True) if t in wanted), d) for d, (h, x) in enumerate(zip(held, values, strict=True))))
        best = lexical_search.Best(10, 1)
        for bucket in made:
            if items.norms[i] * bucket.norms[0] < best.least:
                pruned += len(bucket.ids)
                continue
            scored += int(bucket.survivors(items, i, best.least).sum())
            bucket.search(items, i, best)
        assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == [s for s in scores if s[0] < 0][:10]
    assert pruned > 0 and scored < 20 * n_docs / 2
