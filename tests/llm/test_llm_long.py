"""Very long urls, words and texts: bounded memory, results as for short ones."""

import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from conftest import table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardlight.llm import bpe, language_id, license_scan, packing, periodic_runs, quality, token_count, url_filter

WORDS, PIECES, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))
RULES = [("com/", True), ("example.com/en/", False), ("a.b.c.d.com/x/y/", False)]
LABELS = ".".join(["l"] * 100_000)
LONG_URLS = [
    (f"http://{LABELS}.example.com/en/x", "example.com/en/"), (f"http://{LABELS}.com/", "com/"), (f"http://{LABELS}/en/", None),
    ("http://www.example.com/en/" + "p/" * 500_000, "example.com/en/"), ("http://a.b.c.d.com/x/y/" + "z" * 1_000_000, "a.b.c.d.com/x/y/"),
    ("http://" + "." * 100_000 + "com/", "com/"),
]


@pytest.fixture()
def rules(tmp_path):
    url_filter.DigestRules.write(RULES, str(tmp_path), "own")
    return url_filter.DigestRules(str(tmp_path), "own")


def test_probes_grow_with_the_rules_not_with_the_url(rules):
    for url, rule in LONG_URLS:
        host, path = url_filter.host_and_path(url)
        tracemalloc.start()
        found = rules.first_fits([(host, path)])[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (found and found[0]) == rule
        assert peak < 8 * len(url) + 100_000 and len(rules.probes(host, path)) <= 9


def test_long_urls(spark):
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(LONG_URLS)], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.url_filter(pages, RULES).collect()}
    assert got == {k: rule for k, (_, rule) in enumerate(LONG_URLS)}


LONG = "ab" * 500_000


def test_long_words_are_not_kept():
    words = packing.word_encoder(WORDS)
    (ids,) = words.encode([f"one {LONG} two"])
    assert all(len(w) <= packing.KEPT_LENGTH for w in words.known)
    model = Tokenizer.from_file(WORDS)
    assert np.frombuffer(ids, "<u4").tolist() == model.encode(f"one {LONG} two", add_special_tokens=False).ids
    pieces = token_count.counted(PIECES)
    before = pieces.text(f"one {LONG} two")
    assert all(len(w) <= token_count.KEPT_LENGTH for w in pieces.known) and pieces.text(f"one {LONG} two") == before


def test_the_kept_words_stay_below_their_bound(monkeypatch):
    monkeypatch.setattr(token_count, "KEPT", 100)
    pieces = token_count.Counted(token_count.vocabulary(PIECES))
    whole = pieces.text(" ".join(f"w{k}" for k in range(1000)))
    assert len(pieces.known) <= 100
    assert whole == sum(pieces.text(f"w{k}") for k in range(1000))


def test_texts_of_some_megabytes(spark):
    """One word of a megabyte, and a text of three megabytes, through the operators that look at words."""
    text = " ".join(f"the {k} of house {k % 97}\n" for k in range(120_000))
    docs = table(spark, [(1, LONG, "en"), (2, text, "en"), (3, "short text", "en")])
    began = time.time()
    counts = {r.doc_id: r for r in quality.statistics(docs).collect()}
    assert counts[1].n_words == 1 and counts[1].word_chars == len(LONG) and counts[2].n_words == 600_000
    runs = {r.doc_id: len(r.runs) for r in periodic_runs.periodic_runs(docs).collect()}
    assert runs == {1: 0, 2: 0, 3: 0}
    assert {r.doc_id: r.n_words for r in license_scan.license_scan(docs).collect()} == {1: 1, 2: 600_000, 3: 2}
    found = language_id.language(F.col("text"), language_id.fit(docs, F.lit(True)))
    assert [r.lang_pred for r in docs.select(found.alias("f")).select("f.lang_pred").collect()] == ["en"] * 3
    model = Tokenizer.from_file(BYTES)
    ids = {r.doc_id: r.n_tokens for r in bpe.digests(docs, BYTES).collect()}
    assert ids == {i: len(model.encode(t, add_special_tokens=False).ids) for i, t in ((1, LONG), (2, text), (3, "short text"))}
    assert time.time() - began < 300
