import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in ("th", "an", "er", "on", "re", "st", "in", "ly") for b in ("e", "ing", "ed", "or", "ha", "tion")]


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(VOCABULARY) + r.choice(("", "", "", ",", str(r.randrange(50)))) for _ in range(n)) + "."


def texts(seed: int = 1) -> list[tuple]:
    """Rows with copies, near copies, shared passages and lines, empty, null and very long texts, ties, and rows without an id."""
    r = random.Random(seed)
    rows: list[tuple] = []
    passage = sentence(r, 60)
    line = sentence(r, 9)
    base = "\n".join(sentence(r, 40) for _ in range(4))
    for i in range(60):
        text = "\n".join(sentence(r, r.randrange(1, 40)) for _ in range(r.randrange(1, 7)))
        if i % 7 == 0:
            text = f"{sentence(r, 5)} {passage} {sentence(r, 5)}"
        elif i % 5 == 0:
            text = f"{text}\n{line}\n{sentence(r, 12)}"
        elif i % 11 == 0:
            text = base
        elif i % 13 == 0:
            words = base.split(" ")
            words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        rows.append((i * 3 + 1, text, r.choice(("en", "fr", "de")), f"src{i % 4}", len(text)))
    rows += [(500, None, "en", None, None), (501, "", None, "src0", 0), (502, " \n\t ", "en", "src0", 4), (503, "one", "en", "src1", 3), (504, "one two\x0bthree", "fr", "src1", 13), (None, base, "en", "src1", 5), (None, None, None, None, None)]
    rows += [(505, "the " * 6000, "en", "src2", 24000), (506, "x" * 30000, "en", "src2", 30000), (507, "é ü ñ  日本 <|endoftext|> end", "es", "src3", 9), (507, "é ü ñ  日本 <|endoftext|> end", "es", "src3", 9)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # columns whose names operators use themselves
    for name in ("fp", "rep", "component_id", "anchor", "spans", "line", "gone", "word", "copies", "rate", "p", "x", "value", "score", "salt", "length", "piece", "rank", "found", "y"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
