"""Url rules, tokens, packing, language and quality against plain Python and the libraries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SCHEMA, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from wardlight.llm import bpe, language_id, packing, quality, token_count, url_filter

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SPELLINGS = [
    "a", "B", "the", "ing", "İ", "é", "e\u0301", "1", "23", "!", "'", "'s", "'LL", "#", "日", "😀", "<|endoftext|>", "<|startoftext|>", " ", " ", "\n", "\t",
    "\x1c", "\u00a0", "\u2028", "\u0301", "--", "Σ", "ﬁ", "\x00", "½", "▁", "<0x41>",
]


def texts(seed, n, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(SPELLINGS) for _ in range(rng.randint(0, most))) for _ in range(n)]


# Urls.

RULES = [("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("a.net/", True), ("net/es/x", True)]
URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1?q#f", "http://example.com/en/", "http://example.com/en", "http://badexample.com/en/",
    "http://b.example.com/en/2", "http://x.net/es/xyz", "http://x.net/es/", "http://a.net", "http://q.a.net/#x", "http://net/es/?", "http://e.org/a://b/c", "http://h?x/y", "http://ÉX.com/Ü",
]


def verdict_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = re.match("[^?#]*", url.split("://", 1)[1])[0]
    host, path = re.match("[^/]*", rest)[0], rest[len(re.match("[^/]*", rest)[0]):]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, ok) for r, ok in RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h):])]
    return (host, path, None, "allow") if not fits else (host, path, max(fits)[1], "allow" if max(fits)[2] else "block")


def test_url_filter(spark):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)] + [(None, URLS[5], "x", "y")], "page_id long, url string, host string, rule string")
    got = url_filter.url_filter(pages, RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert tuple(r)[1:] == verdict_by_hand(URLS[5 if r.page_id is None else r.page_id])
    assert url_filter.url_filter(pages, [], default="block").select("verdict").distinct().collect() == [("block",)]
    assert url_filter.url_filter(pages.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.url_filter(pages, [("nopath", True)])


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda raw: len(raw))
    url_filter.DigestRules.write([("ab/", True), ("cd/", False), ("ef/", True)], str(tmp_path), "r")
    rules = url_filter.DigestRules(str(tmp_path), "r")
    assert rules.first_fits([("cd", "/"), ("xx", "/"), ("ef", "/q")]) == [("cd/", False), None, ("ef/", True)]


# Byte-level BPE.

def test_encodings_are_the_librarys():
    model = Tokenizer.from_file(BYTES)
    special = bpe.special_tokens(BYTES)
    for text in texts(1, 800, 100) + [t.replace(" ", "") for t in texts(2, 400, 100)]:
        want = model.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode_text(BYTES, text), np.uint32).tolist() == want
        assert bpe.tree(BYTES, text, 7)[0] == want
        at = [(0, True), *bpe.cuts(text, 20, special)]
        parts = []
        for (begin, sure), end in zip(at, [a for a, _ in at[1:]] + [len(text)], strict=True):
            ids, places = bpe.encoded(BYTES, text[begin:end])
            parts.append((text[begin:end], np.array(ids, np.uint32).tobytes(), np.array(places, np.uint32).tobytes(), sure))
        assert np.frombuffer(bpe.join_pieces(BYTES, parts), np.uint32).tolist() == want
        assert bpe.decoded(BYTES, np.array(want, np.uint32)) == model.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("long", [bpe.LONG, 500])
def test_bpe_table(spark, odd_rows, clash, long):
    model = Tokenizer.from_file(BYTES)
    got = bpe.bpe_decode(bpe.bpe_encode(clash, BYTES, long=long), BYTES).collect()
    want = sorted(((i is not None, i or 0), model.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in odd_rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), np.frombuffer(r.ids, np.uint32).tolist(), r.decoded) for r in got) == want
    assert bpe.digests(spark.createDataFrame([], SCHEMA), BYTES).count() == 0


@pytest.mark.parametrize("long", [bpe.LONG, 500])
def test_digests_take_one_python_step_a_task(spark, odd_rows, clash, long):
    """Two Python steps in a row hold two workers a task, each with a vocabulary."""
    model = Tokenizer.from_file(BYTES)
    found = bpe.digests(clash, BYTES, long=long)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count("FlatMapGroupsInArrow") == 1  # short texts; cut, pieces; joined
    want = []
    for i, t, _ in odd_rows:
        ids = model.encode(t or "", add_special_tokens=False).ids
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), model.decode(ids, skip_special_tokens=False))]
        want.append((i is not None, i or 0, len(ids), *shas))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()) == sorted(want)


# Packing.

def test_word_encodings_are_the_librarys():
    model, own = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    found = texts(3, 2000)
    for text, ids in zip(found, own.encode(found), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def test_piece_lengths():
    for n in (1, 127, 128, 129, 2048, 4095, 4096, 4097, 12_345):
        found = packing.piece_lengths(n)
        assert sum(found) == n and all(0 < p <= 4096 for p in found)
        assert all(p < packing.SHORT or p & (p - 1) == 0 for p in found)


@pytest.mark.parametrize("capacity", [4096, 256])
def test_pack(spark, odd_rows, clash, capacity):
    model = Tokenizer.from_file(WORDS)
    rows = packing.pack(clash, WORDS, capacity=capacity).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    padding = total = 0
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
        total += end
        padding += 0 if end & (end - 1) == 0 else capacity - end
    assert padding <= 0.05 * total
    want = defaultdict(list)
    for i, t, _ in odd_rows:
        want[i] += [*model.encode(t or "", add_special_tokens=False).ids, packing.END]
    for i, ids in want.items():
        assert sum(len(p[1]) for p in pieces[i]) == len(ids) and sorted(x for p in pieces[i] for x in p[1]) == sorted(ids)
    for i in (0, 130, 132, 140):
        assert [x for p in sorted(pieces[i]) for x in p[1]] == want[i] and pieces[i][0][2] == len(want[i])
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS).count() == 0
    crc = packing.digests(packing.pack(table(spark, [(1, "to be", "en")]), WORDS)).first().ids_crc32
    assert crc == zlib.crc32(np.array(want_ids("to be", model), "<u4").tobytes())
    with pytest.raises(ValueError):
        packing.pack(clash, WORDS, capacity=1000)


def want_ids(text, model):
    ids = [*model.encode(text, add_special_tokens=False).ids, packing.END]
    return ids[: 1 << (len(ids).bit_length() - 1)]


# Token counts.

@pytest.mark.parametrize(("fallback", "pieces"), [
    (True, None), (False, [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("bb", -2.5)]),
])
def test_counts_are_the_librarys(fallback, pieces):
    pieces = pieces or token_count.vocabulary(PIECES)
    model = Tokenizer(models.Unigram(pieces, 0, byte_fallback=fallback))
    model.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own = token_count.Counted(pieces)
    rng = random.Random(4)
    for text in texts(5, 800) + ["".join(rng.choice("ababcd ") for _ in range(rng.randint(0, 20))) for _ in range(800)]:
        assert own.text(text) == len(model.encode(text, add_special_tokens=False).ids), text


def test_token_count_table(spark, odd_rows, clash):
    got = token_count.token_count(clash, PIECES).collect()
    own = token_count.counted(PIECES)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.n_tokens) for r in got], key=key) == sorted([(i, own.text(t or "")) for i, t, _ in odd_rows], key=key)
    assert token_count.token_count(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


# Languages.

def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.held_out()
    found = language_id.language(F.col("text"), language_id.fit(docs, ~out))
    rows = docs.select("lang", out.alias("out"), found.alias("f")).where("out").collect()
    assert sum(r.f.lang_pred == r.lang for r in rows) > 0.97 * len(rows)
    assert sum(not r.f.accepted for r in rows) < 0.03 * len(rows) and all(0 <= r.f.score <= 1 for r in rows)


def test_language_edges(spark, odd, clash):
    for docs in (odd, clash):
        found = language_id.language(F.col("text"), language_id.fit(docs, F.lit(True)))
        rows = docs.select("doc_id", "text", found.alias("f")).collect()
        for r in rows:
            if r.text is None or not any(map(str.isalpha, r.text)):
                assert tuple(r.f) == ("und", 0.0, False)
            else:
                assert r.f.lang_pred in {"en", "fr", "de"}
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.fit(empty, F.lit(True)) == {}
    assert odd.select(language_id.language(F.col("text"), {}).alias("f")).select("f.lang_pred").distinct().collect() == [("und",)]
    assert language_id.Compressors({"en": b"the and of"}).judge("the", 0.01) == ("en", 1.0, True)
    assert language_id.Compressors({"b": b"same", "a": b"same"}).judge("tie", 0.01) == ("a", 0.0, False)
    held = spark.createDataFrame([(k,) for k in (None, 1, 2, 3, 4, 5)], "doc_id long").select("doc_id", language_id.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


# Quality.

def counts_by_hand(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    at = defaultdict(list)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    covered = {k + d for own in at.values() if len(own) > 1 for k in own for d in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    return len(words), len("".join(words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, odd_rows, clash):
    extra = [(900 + k, t, None) for k, t in enumerate(["a b a b a b a b a b", "x " * 5, "a b c d e f a b c d e", "\x0b\x0ca\r\nb", "#*$%&|<>", "a\u00a0b 😀"] + texts(6, 40))]
    for docs, rows in ((clash, odd_rows), (table(spark, extra), extra)):
        got = quality.statistics(docs).collect()
        key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(
            ((i, *counts_by_hand(t or "")) for i, t, _ in rows), key=key)
    assert quality.statistics(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cascade_order_changes_nothing(spark, odd):
    counts = quality.statistics(odd)
    rules = quality.text_rules()
    sample = quality.statistics(quality.draw(odd))
    assert {n for n, _ in quality.ordered(sample, rules)} == {n for n, _ in rules}
    kept = {r.doc_id: r.kept for r in quality.cascade(counts.withColumn("kept", F.lit("old")), rules, sample).collect()}
    other = {r.doc_id: r.k for r in counts.select("doc_id", quality.first_failed(rules[::-1]).isNull().alias("k")).collect()}
    assert kept == other and kept[0] and kept[140]
    assert quality.ordered(spark.createDataFrame([], counts.schema), rules) == rules


def test_cheap_and_selective_rules_come_first(spark, monkeypatch):
    measured = [("a", 4.0, 0.5), ("b", 1.0, 0.5), ("c", 1.0, 0.0)]
    monkeypatch.setattr(quality, "measured", lambda sample, rules: measured)
    assert [n for n, _ in quality.ordered(None, [(n, None) for n, _, _ in measured])] == ["b", "a", "c"]


def test_a_rejected_row_evaluates_no_later_rule(spark):
    rules = [("first", F.col("x") > 0), ("second", F.raise_error(F.lit("evaluated")).cast("boolean"))]
    assert spark.createDataFrame([(1,)], "x int").select(quality.first_failed(rules).alias("f")).first().f == "first"
    assert spark.createDataFrame([(None,)], "x int").select(quality.first_failed(rules[:1]).alias("f")).first().f is None


def test_quality_runs_no_python(odd):
    plan = quality.statistics(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
