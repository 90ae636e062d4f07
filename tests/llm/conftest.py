import random

import pytest

# Names that operators use inside, as columns of the input.
CLASHING = ("id", "copy", "group", "bucket", "n", "node", "score", "row", "range", "late", "words", "at", "segment", "host", "purity")


def corpus(seed=7, n=60):
    """Prose with exact and near copies, shared passages, repeated lines, odd characters."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeiourstln") for _ in range(r.randint(2, 8))) for _ in range(400)] + ["été", "日本", "I'll", "42", "don't"]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = prose(60)
    rows = []
    for i in range(n):
        text = prose(r.choice((3, 15, 40, 120, 300)))
        if i % 5 == 1 and i > 5:
            text = rows[r.randrange(len(rows))][1]
        elif i % 5 == 2 and i > 5:
            w = rows[r.randrange(len(rows))][1].split(" ")
            for _ in range(max(1, len(w) // 100)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
        elif i % 7 == 3:
            text = prose(20) + "\n" + passage + "\t" + prose(10)
        elif i % 11 == 4:
            text = "\n".join([prose(9)] * 6 + ["", " "])
        rows.append((i * 3 + 1, text))
    r.shuffle(rows)
    return rows


ODD = [(1000, None), (1001, ""), (1002, " \t\n "), (None, "a lonely text of nobody"), (None, "another text without an id"), (1003, "word"), (1004, "x" * 5000), (1005, "long " * 30000), (1006, "<|endoftext|> <s>\r\n  "), (-5, "Same Words here and There")]


def frame(spark, rows, kind="long"):
    """Documents with other columns, whatever their names."""
    schema = f"doc_id {kind}, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    data = [(d, t, "en", None, None if t is None else len(t), *["?"] * len(CLASHING)) for d, t in rows]
    return spark.createDataFrame(data, schema).repartition(3)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def repeated(spark):
    """Every row twice, and one id with two texts."""
    return frame(spark, corpus(3, 12) * 2 + [(1, "a second text under the first id")])


@pytest.fixture(scope="session")
def labels(spark, rows):
    data = [(d, int("tara" not in t), int(i % 3 == 0)) for i, (d, t) in enumerate(rows)] + [(None, 1, 1), (1, None, None)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")
