import random
from datetime import date, datetime

from pyspark.sql import functions as F

from wardlight.functions import dates, numbers, text


def test_rounding_follows_python_on_the_binary_value(spark):
    rng = random.Random(3)
    tricky = [0.25, 0.75, 96.25, 2.675, 0.15, 0.35, 0.5, 1.5, 2.5, -2.5, -0.04, 9.995, 0.0, 66.65, 12.125, 5.5, 16.5]
    tricky += [rng.randint(0, 4000) / rng.choice([3, 7, 8, 40, 80, 100]) for _ in range(500)]
    columns = [f(F.col("v"), d).alias(f"{n}{d}") for n, f in (("r", numbers.python_round), ("t", numbers.fixed_text)) for d in (0, 1, 2)]
    for row in spark.createDataFrame([(v,) for v in tricky], "v double").select("v", *columns).collect():
        for digits in (0, 1, 2):
            assert row[f"r{digits}"] == round(row.v, digits)
            assert row[f"t{digits}"] == f"{row.v:.{digits}f}"


def test_ratios_are_exact(spark):
    rows = [(2999, 1000), (-2999, 1000), (3, 2), (-3, 2), (1, 3), (5, 0), (90, 60)]
    got = spark.createDataFrame(rows, "a bigint, b bigint").select(
        numbers.trunc_ratio(F.col("a"), F.col("b"), 2), numbers.round_ratio(F.col("a"), F.col("b")),
        numbers.floor_ratio(F.col("a"), F.col("b")),
    ).collect()
    assert [tuple(r) for r in got] == [
        (2.99, 3.0, 2), (-2.99, -3.0, -3), (1.5, 2.0, 1), (-1.5, -2.0, -2), (0.33, 0.0, 0), (None, None, None), (1.5, 2.0, 1),
    ]


def test_month_shifts_keep_month_ends(spark):
    assert dates.shift_months(datetime(2025, 2, 28), -12) == datetime(2024, 2, 29)
    assert dates.shift_months(datetime(2024, 3, 31, 5), -1) == datetime(2024, 2, 29, 5)
    assert dates.shift_months(datetime(2024, 1, 30), 1) == datetime(2024, 2, 29)
    assert dates.shift_months("2024-12-15", 1) == datetime(2025, 1, 15)
    days = [date(2025, 2, 28), date(2024, 3, 31), date(2024, 1, 30), date(2024, 5, 15)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select("d", dates.add_months_eom(F.col("d"), -12).alias("m"))
    for row in got.collect():
        assert row.m == dates.shift_months(datetime(row.d.year, row.d.month, row.d.day), -12).date()


def test_age_in_years(spark):
    rows = [
        ("2000-02-29", "2018-02-28"), ("2000-05-15", "2018-05-14"), ("2000-05-15", "2018-05-15"),
        ("2018-05-15", "2018-05-14"), (None, "2018-05-15"),
    ]
    df = spark.createDataFrame(rows, "b string, a string").select(
        dates.age_years(F.col("b").cast("timestamp_ntz"), F.col("a").cast("timestamp_ntz"))
    )
    assert [r[0] for r in df.collect()] == [18, 17, 18, 0, None]


def test_text_rules(spark):
    rows = [("Se dor",), ("se",), ("CONFORME x",), (None,), ("CEFALEXINA DIPIRONA",), ("dipirona",)]
    rules = [("A", ["CEF"]), ("B", ["DIPIRONA"])]
    got = spark.createDataFrame(rows, "t string").select(
        text.not_starting_with(F.col("t"), ["SE ", "CONFORME"]),
        text.keyword_class(F.col("t"), rules, "C"),
        text.joined(F.col("t"), " - ", F.lit(None).cast("string")),
        text.label_of(F.col("t"), {"se": "x"}),
    ).collect()
    assert [tuple(r) for r in got] == [
        (False, "C", "Se dor - ", None), (True, "C", "se - ", "x"), (False, "C", "CONFORME x - ", None),
        (True, "C", " - ", None), (True, "A", "CEFALEXINA DIPIRONA - ", None), (True, "B", "dipirona - ", None),
    ]
