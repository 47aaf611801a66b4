"""Operators with one key that holds a third of all rows, shuffle joins forced."""

import pytest
from hospital import AS_OF, values
from pyspark.sql import functions as F

from wardlight.operators import counting, encounters, pharmacy, queues

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}
ROWS = 300_000


@pytest.fixture(autouse=True)
def skew_settings(spark):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture()
def items(spark):
    """A third of the items belong to order 0, and a third are of product 0."""
    return spark.range(0, ROWS, 1, 8).select(
        F.when(F.col("id") < ROWS // 3, 0).otherwise(F.col("id")).alias("rx"),
        F.when(F.col("id") >= 2 * ROWS // 3, 0).otherwise(F.col("id") % 50).alias("product"),
        F.sha2(F.col("id").cast("string"), 256).alias("filler"),
    )


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_join_key_is_split(spark, items):
    orders = spark.range(0, ROWS, 1, 8).select(
        F.col("id").alias("rx"), F.lit(AS_OF).cast("timestamp_ntz").alias("t"),
        F.md5(F.col("id").cast("string")).alias("note"),
    )
    joined = items.join(orders, "rx")
    counted = counting.monthly_count(joined.withColumn("x", F.length("filler") + F.length("note")), "t", ["x"])
    assert values(counted) == [("2024-05", 96, ROWS)]
    assert "skew=true" in final_plan(counted)


def test_hot_product_is_counted_before_its_name_is_joined(spark, items):
    products = spark.range(50).select(F.col("id").alias("product"), F.format_string("n%02d", "id").alias("name"))
    top = pharmacy.top_k_by_count(items, "product", 3, lookup=products, name="name")
    want = items.groupBy("product").count().orderBy(F.desc("count"), "product").limit(3).collect()
    assert [(r.name, r.qtde) for r in top.collect()] == [(f"n{w.product:02d}", w["count"]) for w in want]
    plan = final_plan(top)
    assert plan.index("SortMergeJoin") < plan.rindex("HashAggregate(keys=[product")


def test_hot_visit_is_one_row_before_any_join(spark, items):
    visits = spark.range(ROWS).select(F.col("id").alias("rx"), F.lit(AS_OF).cast("timestamp_ntz").alias("t"))
    stalled = queues.stalled_at_step(visits, items, "rx", "product", 0, F.col("product") > 0, AS_OF, "t")
    per_visit = items.groupBy("rx").agg(F.max("product").alias("last"))
    assert values(stalled) == [(per_visit.filter("last = 0").count(),)]
    single = queues.single_event_queue(visits, items, "rx", AS_OF, "t")
    assert values(single) == [(ROWS - ROWS // 3,)]


def test_hot_encounter_list_gathers_each_text_once(spark, items):
    texts = items.filter("rx = 0").select("rx", F.format_string("n%02d", "product").alias("t"))
    got = encounters.ordered_list(texts, "rx", "t").first().lista.split(" | ")
    assert len(got) == ROWS // 3 and got == sorted(got)
