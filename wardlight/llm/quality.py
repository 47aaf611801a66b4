"""Quality rules as a short-circuit cascade of built-in expressions.

A rule is a condition that rejects a row.  ``cascade`` measures every rule on a
bounded sample: its cost (time of evaluating it alone, beyond reading the
sample) and its selectivity (share of rows it rejects), and orders the rules by
rejections per cost.  The order only decides what is evaluated first: the verdict
is the same in any order, as a row is kept if no rule rejects it.  Rules are
nested in one conditional expression, so a row that an early rule rejects never
evaluates a later one.

Nulls and edges: a null text has no words and no lines; a rule that is null on a
row does not reject it; repeated rows are judged one by one; an empty table (or
sample) leaves the rules in the order given.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import drawn
from wardlight.session import written

SAMPLE = 1000  # rows of the sample, those whose ids have the least hashes
WINDOW = 5
SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"

Rule = tuple[str, Column]


# Counts of a text.  A step that reads an array more than once gets it as a column of its
# own, as Spark does not fold such a column into the step; within one expression it would be
# evaluated again for each use.

def words(trimmed: Column) -> Column:
    """The words of a text without white space at its ends, in order."""
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+", -1))


def symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("long")


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))


def with_window_hashes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``hashes``, 64-bit hashes of the windows of five words of ``words``.

    Words are hashed once; windows of two, four and five come from those next to each other.
    """

    def pair(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b)

    def later(column: str, by: int) -> Column:
        return F.slice(column, by + 1, F.size("words"))

    ones = rows.withColumn("ones", F.transform("words", lambda w: F.xxhash64(w)))
    twos = ones.withColumn("twos", F.zip_with("ones", later("ones", 1), pair))
    fours = twos.withColumn("fours", F.zip_with("twos", later("twos", 2), pair))
    fives = F.zip_with("fours", later("ones", 4), pair)
    # the last four stand for windows beyond the end
    return fours.withColumn("hashes", F.slice(fives, 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))))


def placed(hashes: Column) -> Column:
    """Hashes with their places, sorted."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_places(sorted_hashes: Column) -> Column:
    """Sorted places of the windows whose hash occurs more than once: in ``placed``, equal ones are neighbours."""
    n = F.greatest(F.size(sorted_hashes) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(sorted_hashes, 1, n), F.slice(sorted_hashes, 2, n),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))


def covered(places: Column, size: int = WINDOW) -> Column:
    """How many places lie in windows of ``size`` that begin at the sorted ``places``."""
    return F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("total"), F.lit(-size).cast("long").alias("last")),
        lambda s, p: F.struct(
            (s["total"] + F.least(p.cast("long") - s["last"], F.lit(size).cast("long"))).alias("total"), p.cast("long").alias("last"),
        ),
        lambda s: s["total"],
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text and its counts."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trimmed = base.withColumn("trimmed", F.trim("text", F.lit(" \t\n\x0b\f\r")))
    split = trimmed.withColumn("words", words(F.col("trimmed"))).withColumn("lines", lines(F.col("text"))).drop("trimmed")
    hashed = with_window_hashes(split).select("doc_id", "text", "words", "lines", "hashes")
    some = F.size("hashes") > F.size(F.array_distinct("hashes"))
    return hashed.withColumn("placed", F.when(some, placed(F.col("hashes")))).select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), symbols(F.col("text")).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered(repeated_places(F.col("placed")), WINDOW), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


# The cascade.

def measured(sample: DataFrame, rules: list[Rule]) -> list[tuple[str, float, float]]:
    """Name, cost in seconds and rejected share of each rule on the sample."""

    def seconds(column: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(2):  # the first run also compiles
            start = time.perf_counter()
            share = sample.agg(F.avg(column.cast("int"))).first()[0] or 0.0
            best = min(best, time.perf_counter() - start)
        return best, share

    floor, _ = seconds(F.lit(False))
    out = []
    for name, condition in rules:
        cost, share = seconds(F.coalesce(condition, F.lit(False)))
        out.append((name, max(cost - floor, 1e-4), share))
    return out


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """A bounded sample: the rows whose ids and texts have the least hashes."""
    rank = F.xxhash64(id_col, text_col)
    return written(docs.where(drawn(rank, docs.count(), sample)).orderBy(rank, id_col).limit(sample), "sample")


def ordered(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejections per cost on a written sample, the best first; equal ones as given."""
    rate = {name: share / cost for name, cost, share in measured(sample, rules)}
    return sorted(rules, key=lambda r: -rate[r[0]])


def first_failed(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects a row, evaluated only as far as needed; null if none does."""
    return reduce(lambda rest, rule: F.when(F.coalesce(rule[1], F.lit(False)), F.lit(rule[0])).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def cascade(docs: DataFrame, rules: list[Rule], sample: DataFrame) -> DataFrame:
    """``docs`` with ``failed_rule`` and ``kept``; an existing column of either name is replaced.

    ``sample`` has the columns that the rules read, for rows drawn from ``docs``.
    """
    return docs.withColumn("failed_rule", first_failed(ordered(sample, rules))).withColumn("kept", F.col("failed_rule").isNull())


def text_rules() -> list[Rule]:
    """Rules on a text and its counts.

    Limits: words of 2 to 20 characters on average; at most a symbol in ten
    characters; at most 30 % repeated lines; at least half of the characters letters.
    """
    return [
        ("few_letters", 2 * F.length(F.regexp_replace("text", r"\P{L}+", "")) < F.col("word_chars")),
        ("short_words", F.col("word_chars") < 2 * F.col("n_words")),
        ("long_words", F.col("word_chars") > 20 * F.col("n_words")),
        ("symbols", 10 * F.col("n_symbols") > F.col("word_chars")),
        ("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    ]
