import random

import pytest

#: Columns that operators make on their way; as extra columns of the input they must not get in the way.
CLASHES = ["id", "row", "run", "norm", "h", "p", "host", "size", "kept", "text_sha256", "blob", "spans", "words", "n", "key", "class_id", "sequence_id", "bucket", "start"]


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "ere", "tion", "über", "été", "x1", "A", "B,"]) + rng.choice(["", "s", "ing", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def nasty_rows():
    """(doc_id, text, lang, source): nulls in any column, empty and very long texts, repeated rows and ids."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    return [
        (1, "Hello World, this is a small text.", "en", "a"),
        (2, "hello world, THIS is a small text.", "en", "b"),
        (2, "hello world, THIS is a small text.", "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, "   \n\t ", "fr", "c"),
        (6, long, "en", "a"),
        (7, long.upper(), "de", "b"),
        (8, "x" * 70_000, "de", None),
        (9, "Ünïcödé ÄÖÜ \U0001f600 ſtraße K <|endoftext|> end", "de", "c"),
        (10, "a\nb\nb\n\n b\nb", None, "a"),
        (None, "no id at all", "fr", "a"),
        (None, None, None, None),
        (-11, "the same words again and " * 40, "en", "d"),
        (12, "word" + "   \n  word  " * 50, "en", "d"),
        *[(100 + i, words(rng, rng.randrange(1, 60)), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(60)],
    ]


@pytest.fixture(scope="session")
def nasty(spark, nasty_rows):
    rows = [r + tuple("clash" for _ in CLASHES) for r in nasty_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
