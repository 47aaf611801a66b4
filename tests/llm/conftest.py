import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use themselves
CLASHES = "row string, text_key long, fp long, cut string, kept string, spans string, starts string, a long, words string, lines string, accepted string"


def table(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text, lang)."""
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], schema)


def clashing(spark, rows):
    return spark.createDataFrame(
        [(i, t, lang, "s", None if t is None else len(t), *[None if " long" in c else "x" for c in CLASHES.split(", ")]) for i, t, lang in rows],
        f"{SCHEMA}, {CLASHES}",
    )


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages, a hot line."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def prose(n):
        out = [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ","]) for _ in range(n)]
        return "".join(w + ("\n" if k % 9 == 8 else " ") for k, w in enumerate(out)).strip()

    passage, long = prose(120), prose(9000)
    bodies = [prose(rng.randint(20, 200)) for _ in range(25)]
    rows = [(k, b, "en") for k, b in enumerate(bodies)]
    rows += [(100 + k, bodies[3], "en") for k in range(6)]  # copies
    rows += [(110 + k, bodies[4].replace(" ", "  ", k), "fr") for k in range(4)]  # near copies
    rows += [(120 + k, prose(30) + "\n" + passage + "\n" + prose(30), "en") for k in range(4)]  # a shared passage
    rows += [(130, long, "en"), (131, long + " end", "en"), (132, "x" * 1200, None), (133, "ab" * 700, "de")]
    rows += [(140, None, None), (141, "", "en"), (142, "  \n\t ", "en"), (143, "Ünïcödé ß 日本 😀 \x1c <|endoftext|> it's", "de"), (144, "one", "en")]
    rows += [(150, bodies[5], "en")] * 2  # a row twice
    rows += [(151, "same id", "en"), (151, "other text", "en"), (None, bodies[6], "en"), (None, "no id", None), (None, "no id", None)]
    rows += [(160, "\n".join(["hot line"] * 7), "en"), (161, "hot line\nhot line\nhot line", "en"), (-5, bodies[7] + "\n" + "z" * 20, "en")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table(spark, odd_rows).repartition(3)


@pytest.fixture(scope="session")
def clash(spark, odd_rows):
    """The odd rows with further columns of clashing names."""
    return clashing(spark, odd_rows).repartition(2)
