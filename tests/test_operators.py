import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from hospital import AS_OF, at, table, values
from pyspark.sql import functions as F

from wardlight import fixed
from wardlight.functions.dates import day_so_far
from wardlight.operators import aging, counting, encounters, pharmacy, queues, stays, waits

STEPS = "visit bigint, step int, ts timestamp_ntz"


def test_monthly_evolution_bounds_labels_and_order(spark):
    moments = ["2030-12-31 23:59:58", "2031-01-01 00:00:00", "2025-01-01 00:00:00", "2024-12-31 23:59:59", "2026-02-01 00:00:00"]
    df = spark.createDataFrame([(at(m), k) for m, k in zip(moments, "IIIIX")], "t timestamp_ntz, k string")
    got = values(counting.monthly_evolution(df, "t", "k", fixed.ENCOUNTER_TYPES, None, 2025, 2030))
    assert got == [("01/2025", "Internação", 1), ("02/2026", None, 1), ("12/2030", "Internação", 1)]
    own_year = counting.monthly_evolution(df, "t", "k", fixed.ENCOUNTER_TYPES, as_of="2026-07-01", with_month=True)
    assert values(own_year) == [("02/2026", None, datetime(2026, 2, 1).date(), 1)]


def test_period_indicators_are_closed_at_the_moment(spark):
    df = spark.createDataFrame([(AS_OF.replace(hour=0),), (AS_OF,), (AS_OF + timedelta(seconds=1),)], "t timestamp_ntz")
    today = day_so_far(F.col("t"), AS_OF)
    got = values(counting.period_indicators(df, [("a", today), ("b", today & (F.col("t") > F.lit("2024-05-15 01:00").cast("timestamp_ntz")))]))
    assert got == [(1, "a", 2), (2, "b", 1)]
    assert values(counting.count_in_period(df, "t", "2024-05-15", AS_OF)) == [(2,)]
    assert values(counting.period_indicators(df.limit(0), [("a", today)])) == [(1, "a", 0)]


def test_monthly_count_groups_by_code_and_keeps_null_month(spark):
    df = spark.createDataFrame(
        [(at("2024-02-29"), "P"), (at("2024-02-01"), "X"), (at("2024-02-02"), "Y"), (None, "P")], "t timestamp_ntz, k string"
    )
    got = values(counting.monthly_count(df, "t", ["k"], {"k": fixed.SURGERY_SIZES}))
    assert sorted(got, key=str) == sorted(
        [("2024-02", "Pequeno Porte", 1), ("2024-02", None, 1), ("2024-02", None, 1), (None, "Pequeno Porte", 1)], key=str
    )
    assert values(counting.monthly_count(df, "t", since="2024-02-02").select("qtde")) == [(2,)]


def visit_tables(spark, steps):
    rows = [(v, s, AS_OF + timedelta(minutes=m)) for v, items in steps.items() for m, s in enumerate(items)]
    visits = spark.createDataFrame([(v, AS_OF) for v in steps], "visit bigint, arrival timestamp_ntz")
    return visits, spark.createDataFrame(rows, STEPS)


def test_stalled_visits(spark):
    visits, events = visit_tables(spark, {1: [12], 2: [12, 20], 3: [1, 12], 4: [1], 5: [12, 12]})
    old = visits.filter("visit <> 5")
    stalled = queues.stalled_at_step(old, events, "visit", "step", 12, F.col("step") > 12, AS_OF, "arrival")
    assert values(stalled) == [(2,)]
    late = queues.stalled_at_step(visits, events, "visit", "step", 12, F.col("step") > 12, AS_OF + timedelta(1), "arrival")
    assert values(late) == [(0,)]


def test_stalled_for_medication(spark):
    visits, events = visit_tables(spark, {1: [32], 2: [32], 3: [32, 71], 4: [32, 33]})
    pending = spark.createDataFrame([(1,), (1,), (3,), (4,)], "visit bigint")
    stalled = queues.stalled_at_step(
        visits, events, "visit", "step", 32, F.col("step") >= 71, AS_OF, "arrival", pending
    )
    assert values(stalled) == [(2,)]


def test_single_event_queue(spark):
    visits, events = visit_tables(spark, {1: [1], 2: [1, 1], 3: [5]})
    assert values(queues.single_event_queue(visits, events, "visit", AS_OF, "arrival")) == [(2,)]
    assert values(queues.single_event_queue(visits, events.limit(0), "visit", AS_OF, "arrival")) == [(0,)]


def test_frequent_returners(spark):
    rows = [(1, i, AS_OF) for i in (1, 2)] + [(2, i, AS_OF) for i in (3, 4, 5)] + [(3, 6, AS_OF)] * 3
    rows += [(4, i, AS_OF - timedelta(days=8)) for i in (7, 8, 9)]
    df = spark.createDataFrame(rows, "p bigint, e bigint, t timestamp_ntz")
    assert values(queues.frequent_returners(df, "p", "e", "t", AS_OF, 7, 2)) == [(1,)]


def test_hourly_arrivals(spark):
    visits, events = visit_tables(spark, {1: [1, 1], 2: [1], 3: [5]})
    visits = visits.withColumn("arrival", F.expr("arrival + make_interval(0, 0, 0, 0, cast(visit as int))"))
    got = values(counting.hourly_arrivals(visits, events, "visit", "arrival", AS_OF, "step", 1))
    assert got == [("15/05/2024", "14", 1), ("15/05/2024", "13", 2)]


def wait_by_pairs(rows, start, end):
    minutes = [
        int((Decimal((b[2] - a[2]) // timedelta(microseconds=1)) / 60_000_000).quantize(0, rounding=ROUND_HALF_UP))
        for a in rows for b in rows if a[0] == b[0] and a[1] == start and b[1] == end
    ]
    return len(minutes), sum(minutes)


def test_wait_equals_all_pairs_with_a_hot_visit(spark):
    rng = random.Random(11)
    rows = []
    for visit in range(30):
        size = 150 if visit == 0 else rng.randint(0, 8)
        grain = rng.choice([30_000_000, 1_000_000, 1])
        for _ in range(size):
            micros = rng.randrange(0, 7_200_000_000 // grain) * grain
            rows.append((visit, rng.choice([1, 11]), AS_OF + timedelta(microseconds=micros)))
    events = spark.createDataFrame(rows, STEPS)
    totals = waits.pair_minutes(waits.step_instants(events, "visit", "step", "ts", 1, 11), "visit").first()
    assert (int(totals.pairs), int(totals.total)) == wait_by_pairs(rows, 1, 11)


def wait(spark, seconds, fold):
    rows = [(1, 1, AS_OF)] + [(1, 11, AS_OF + timedelta(seconds=s)) for s in seconds]
    visits = spark.createDataFrame([(1, AS_OF)], "visit bigint, arrival timestamp_ntz")
    events = spark.createDataFrame(rows, STEPS)
    return values(waits.step_wait(visits, events, "visit", "step", "ts", 1, 11, "arrival", AS_OF, fold_hours=fold))[0]


def test_wait_folding(spark):
    assert wait(spark, [59 * 60], True) == (59.0, 59.0)
    assert wait(spark, [3600], True) == (0.0, 60.0)
    assert wait(spark, [61 * 60], True) == (61 / 60, 61.0)
    assert wait(spark, [5400], True) == (1.5, 90.0)
    assert wait(spark, [5400], False) == (90.0, 90.0)
    assert wait(spark, [84, 90], False) == (2.0, 2.0)
    assert wait(spark, [], True) == (0.0, None)


def test_durations(spark):
    rows = [("a", AS_OF, AS_OF + timedelta(days=2, hours=23, minutes=59)), ("b", AS_OF, AS_OF + timedelta(minutes=119, seconds=42)),
            ("c", None, AS_OF)]
    df = spark.createDataFrame(rows, "g string, s timestamp_ntz, e timestamp_ntz")
    assert values(stays.mean_stay_by_group(df, "g", "s", "e")) == [("c", None), ("a", 2.99), ("b", 0.08)]
    totals = waits.duration_totals(df, ["g"], "s", "e")
    assert values(waits.mean_duration_hm(totals.filter("g = 'b'"), "g")) == [("b", 1, 60.0)]


def test_occupied_beds(spark):
    units = table(spark, "unid_int", [
        {"cd_unid_int": 1, "ds_unid_int": "Uti 1", "sn_ativo": "S"}, {"cd_unid_int": 2, "ds_unid_int": "UTI 10", "sn_ativo": "S"},
        {"cd_unid_int": 3, "ds_unid_int": "UTI 2", "sn_ativo": "S"}, {"cd_unid_int": 4, "ds_unid_int": "UTI 1 B", "sn_ativo": "N"},
    ])
    beds = table(spark, "leito", [
        {"cd_leito": 1, "cd_unid_int": 1}, {"cd_leito": 2, "cd_unid_int": 2, "dt_desativacao": AS_OF},
        {"cd_leito": 3, "cd_unid_int": 2}, {"cd_leito": 4, "cd_unid_int": 3}, {"cd_leito": 5, "cd_unid_int": 4},
    ])
    got = stays.occupied_beds(beds, units, "UTI 1", where=F.col("dt_desativacao").isNull(), units_where=F.col("sn_ativo") == "S")
    assert values(got) == [(2,)]
    assert values(stays.occupied_beds(beds.limit(0), units, "UTI 1")) == [(0,)]


def test_age_bands(spark):
    births = {"2007-05-16": "0–17", "2006-05-15": "18–59", "1964-05-16": "18–59", "1964-05-15": "60+", None: "60+"}
    df = spark.createDataFrame([(at(b), AS_OF, e) for b, e in births.items()], "b timestamp_ntz, t timestamp_ntz, want string")
    got = stays.count_by_age_band(df, "b", "t", fixed.AGE_BANDS, fixed.LAST_AGE_BAND, ["want"])
    assert all(row.faixa == row.want for row in got.collect())


def test_top_k_is_sort_and_limit_with_name_order_for_ties(spark):
    rows = [(p, f"n{p:02d}") for p in range(24)]
    products = spark.createDataFrame(rows, "p bigint, name string")
    items = spark.createDataFrame([(p, None) for p in range(24) for _ in range(1 if p > 17 else 30 - p)] + [(3, "se dor")] * 50, "p bigint, t string")
    got = values(pharmacy.top_k_by_count(items, "p", 20, text="t", exclude_prefixes=fixed.CONDITIONAL_PREFIXES, lookup=products, name="name"))
    assert [g[0] for g in got] == [f"n{p:02d}" for p in range(20)]
    assert [g[2] for g in got] == list(range(1, 21))
    assert got[3][1] == 27


def test_keyword_classes_partition_the_items(spark):
    products = spark.createDataFrame([(1, "CEFALEXINA DIPIRONA"), (2, "Dipirona"), (3, "Soro"), (4, None)], "p bigint, name string")
    items = spark.createDataFrame([(p, at("2024-05-03 10:00")) for p in (1, 1, 2, 3, 4)], "p bigint, t timestamp_ntz")
    got = values(pharmacy.keyword_class_monthly(items, "t", "p", products, "name", fixed.DRUG_CLASSES, fixed.OTHER_DRUGS))
    assert sorted(got) == [(at("2024-05-01"), "ANALGESICO", 1), (at("2024-05-01"), "ANTIBIOTICO", 2), (at("2024-05-01"), "OUTROS", 2)]


def test_aging_edges_and_partition(spark):
    ages = {1: 12 * 3600, 2: 12 * 3600 + 1, 3: 24 * 3600, 4: 24 * 3600 + 1, 5: -3600, 6: None}
    df = spark.createDataFrame(
        [(i, None if a is None else AS_OF - timedelta(seconds=a)) for i, a in ages.items()], "id bigint, t timestamp_ntz"
    )
    got = values(aging.aging(df, "t", AS_OF, columns=["id"]))
    assert sorted(got) == [
        (1, 12.0, "ate_12h"), (2, 12.0, "12_24h"), (3, 24.0, "12_24h"), (4, 24.0, "mais_24h"), (5, -1.0, "ate_12h")
    ]
    assert [g[1] for g in got] == [24.0, 24.0, 12.0, 12.0, -1.0]
    parts = [g for name, _, _ in aging.AGE_BUCKETS for g in values(aging.aging(df, "t", AS_OF, columns=["id"], only=name))]
    assert sorted(parts) == sorted(got)


def test_latest_reading(spark):
    rows = [
        (1, 1, 10.0, AS_OF, 1), (1, 1, 20.0, AS_OF + timedelta(1), 2), (1, 2, 5.0, AS_OF, 3), (1, 2, 6.0, AS_OF, 4),
        (2, 1, 7.0, AS_OF, 5), (2, 1, None, AS_OF + timedelta(1), 6), (3, 1, 8.0, None, 7), (3, 1, 9.0, AS_OF, 8),
    ]
    df = spark.createDataFrame(rows, "k bigint, c int, v double, t timestamp_ntz, id bigint")
    got = values(encounters.latest_pivot(df, ["k"], "c", "v", "t", "id", {1: "a", 2: "b"}))
    assert sorted(got) == [(1, 20.0, 6.0), (2, None, None), (3, 8.0, None)]


def test_ordered_list_keeps_repeats(spark):
    df = spark.createDataFrame([(1, "B"), (1, "A"), (1, "B"), (1, None), (2, "Z |")], "k bigint, t string")
    assert sorted(values(encounters.ordered_list(df, "k", "t"))) == [(1, "A | B | B"), (2, "Z")]
