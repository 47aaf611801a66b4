"""The queries against SQL, and the pipeline's stages against plain Python on their own input."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import SCHEMA, table
from pyspark.sql import functions as F
from test_llm_dedup import fingerprint_by_hand, groups_by_hand, lines_by_hand, unique, windows_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from wardlight.llm import language_id, packing
from wardlight.llm.queries import QUERIES
from wardlight.llm.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = duck.execute(SQL[name])
    places = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(places) == columns
    assert got == sorted(repr(tuple(r[places[c]] for c in columns)) for r in result.fetchall())


@pytest.mark.parametrize("name", [q for q in QUERIES if q != "op12_lexical_search"])  # which lists the best only
def test_every_query_reads_all_rows(spark, name):
    df, table = QUERIES[name](spark, SF), "pages" if name.startswith("op2") else "documents"
    ids = {r[0] for r in df.select(f"{table[:-1] if table == 'pages' else 'doc'}_id").distinct().collect()}
    assert len(ids) == spark.read.parquet(f"{SF}/{table}.parquet").count()


def rows_of(df):
    return [(r.doc_id, r.text, r.lang) for r in df.collect()]


def check_stages(spark, docs, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_near_dedup", "suffix_dedup", "packing"]
    tables = [docs]
    for k, stage in enumerate(stages.values()):
        stage(spark, tables[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        tables.append(spark.read.parquet(f"{tmp_path}/{k}"))
    for before, after in zip(tables[:4], tables[1:5], strict=True):
        assert after.columns == before.columns
    whole, clear, lines, near, cut = map(rows_of, tables[:5])

    own = language_id.Compressors(language_id.fit(docs, F.lit(True)))
    assert Counter(clear) == Counter(r for r in whole if own.judge(r[1], language_id.MARGIN)[2])

    want = lines_by_hand(clear)
    assert Counter(lines) == Counter((i, None if t is None else want[i, t or ""], lang) for i, t, lang in clear)

    left = unique(lines)
    roots = groups_by_hand([fingerprint_by_hand(t) for _, t in left], 3)
    groups = defaultdict(list)
    for (i, t), root in zip(left, roots, strict=True):
        groups[root].append((i, t))
    staying = [(i, t or "") for i, t, _ in near]
    assert len(staying) == len(groups) and set(staying) <= set(left)
    for group in groups.values():
        kept = [r for r in group if r in set(staying)]
        assert len(kept) == 1 and kept[0][0] == min([i for i, _ in group if i is not None], default=None)

    texts = [t.encode() for _, t in unique(near)]
    after = {}
    length = corpus_pipeline.PASSAGE_BYTES
    for row, raw, starts in zip(unique(near), texts, windows_by_hand(texts, length), strict=True):
        gone = np.zeros(len(raw), bool)
        for s in starts:
            gone[s : s + length] = True
        after[row] = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")
    assert Counter(cut) == Counter((i, None if t is None else after[i, t], lang) for i, t, lang in near)

    model, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in tables[5].collect():
        pieces.update(np.frombuffer(r.ids, "<u4").tolist())
    wanted = Counter()
    for _, t, _ in cut:
        wanted.update([*model.encode(t or "", add_special_tokens=False).ids, packing.END])
    assert pieces == wanted


def test_stages_on_odd_rows(spark, odd, tmp_path):
    check_stages(spark, odd, tmp_path)


def test_stages_with_clashing_columns(spark, clash, tmp_path):
    check_stages(spark, clash, tmp_path)


def test_stages_on_the_smallest_documents(spark, tmp_path):
    check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)


def test_passages_of_51_words_are_taken_out(spark):
    """A passage in two documents goes from both; it is the shortest kind that the pipeline promises to find."""
    rng = random.Random(1)

    def prose(n):
        return " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 7))) for _ in range(n))

    passage = prose(51)
    alone = [(k, prose(rng.randint(20, 200)), "en") for k in range(20)]
    docs = table(spark, [(100, f"{prose(30)} {passage} {prose(20)}", "en"), (101, f"{prose(80)}\n{passage}", "en"), *alone])
    out = {r.doc_id: r.text for r in corpus_pipeline.remove_repeats(spark, docs, "").collect()}
    assert len(out) == 22 and all(out[i] == t for i, t, _ in alone)
    assert passage not in out[100] and passage not in out[101] and len(out[100].split()) in (50, 51, 52)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
