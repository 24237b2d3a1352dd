"""Small tables with every odd case: null ids and texts, empty and very long texts, repeated rows, clashing column names."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, id long, name string, key double, v long, "
          "_sha string, _id long, rid long, score double, component string, range int, n int, token long")


def prose(rng, words, letters="abcde"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(words))


def odd_rows():
    rng = random.Random(7)
    long = prose(rng, 60_000, "abcdefghij")
    base = prose(rng, 120, "abcdefghijklmnop")
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    far = " ".join(words[:40] + ["quite", "another", "end"] * 9)
    texts = [(0, base), (1, near), (2, far), (3, base), (4, ""), (5, None), (6, " \t\n "), (7, "one"), (8, "one"), (9, "One two three"),
             (10, long), (11, long + " end"), (12, long), (None, base), (None, "no id"), (None, None), (13, base.upper()), (14, base), (14, base),
             (15, "x\ny\n\nz " * 50), (16, "é ß ñ   \x1c Σ <|endoftext|> 'S ' 12 ..."), (17, "\x00 \U0001f600 á")]
    rows = []
    for i, (d, t) in enumerate(texts):
        source = [None, "a", "b", "", "a"][i % 5]
        rows.append((d, t, None if i % 3 else "en", source, None if t is None else len(t), "r", i, "n", 1.0, 5, "s", 3, 9, 0.5, "c", 1, 2, 3))
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "docs")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(0, 16)] + [(None, 1, 0), (99, 0, 1), (3, None, None), (2, 0, 1), (2, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
