import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, size int, shard int, _words int, fp string, block int"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    made = ["".join(r.choices(["th", "an", "er", "on", "in", "é", "ß", "que"], k=r.randint(1, 4))) for _ in range(300)]
    return " ".join(r.choice(made) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(words))


def document_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows,
    strange white space, special strings, and columns whose names operators use themselves."""
    base = prose(1, 400)
    near = base.replace("th", "ht", 2)
    long = prose(2, 30_000)
    texts = [
        base, base, near, None, "", " \n\t ", long, "Übergrößen naïve café ́x 日本語 🙂 ﬁ",
        "a <|endoftext|> b<|startoftext|>c </s> <s> ▁x <0x0A>", "x  y\t\tz\n\n w\x1cv u t \r\n ", base[:900], "one two three",
        " ".join(f"w{i}" for i in range(13)), " ".join(f"w{i}" for i in range(12)), prose(3, 60) + " " + base[200:900], "same line\n" * 40,
        "THE END OF " * 30, "### $$$ %%% " * 20 + prose(4, 30), prose(5, 200),
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, base), (18, texts[18]), (None, base), (None, "no id " + prose(6, 40)), (18, prose(7, 50))]
    rows += [(100 + i, prose(8, 25) + f" v{i}") for i in range(30)] + [(200 + i, prose(9, 150)) for i in range(25)]
    source = [None, "a", "b", "c", "é"]
    return [(i, t, None if k % 7 == 3 else "en", source[min(k % 9, 4)], None if t is None else len(t), "x", k, k, k, "y", k) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
