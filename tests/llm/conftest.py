import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves; documents may bring columns called so.
CLASHING = ["size", "key", "row", "score", "shard", "slot", "anchor", "target", "taken", "position", "fp", "root", "before"]


def sentence(draw, words=12, letters="abcdefgh"):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 6))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, blanks, repeated rows, equal texts and ids."""
    draw = random.Random(5)
    plain = sentence(draw)
    rows = [(i, sentence(draw, draw.randint(3, 80)), "en", f"s{i % 3}", 1) for i in range(1, 40)]
    rows += [
        (100, plain, "en", "s0", 3), (101, plain, None, None, None), (102, plain.upper(), "en", "s1", 1),
        (103, None, "en", "s1", None), (104, "", "de", "s0", 0), (105, " \n\t ", None, "s9", 4),
        (None, plain, "en", "s0", 1), (None, None, None, None, None), (106, "Une é phrase, naïve!", "fr", None, 1),
        (107, sentence(draw, 30_000), "en", "s2", 9), (100, plain, "en", "s0", 3), (100, "another text here", "en", "s0", 3),
        (108, "0123456789", "en", "s2", 2), (109, "\u4e2d\u6587 \U0001f600", "zh", "s2", 2),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    rows = [(*row, *[str(i)] * len(CLASHING)) for i, row in enumerate(odd_rows)]
    return spark.createDataFrame(rows, COLUMNS + "".join(f", {name} string" for name in CLASHING)).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)
