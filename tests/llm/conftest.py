import random

import pytest

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
SHARED = "this passage of well over fifty bytes stands in several documents, word for word, as it is."


def prose(seed, n=120):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rnd.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with nulls, empty and very long texts, copies, near copies, repeated rows and shared passages."""
    near = prose(1, 400)
    return [
        (0, prose(0)), (1, near), (2, near), (3, near.replace(near.split()[200], "changed", 1)), (4, None), (5, ""), (6, "   \n\t "),
        (7, LONG), (8, "one"), (9, "one two"), (10, "One TWO three"), (11, prose(11) + " " + SHARED), (12, SHARED + " " + prose(12)),
        (13, "ab " * 500), (14, "ab " * 700), (15, "x" * 300), (16, "y" + "x" * 300), (17, "ÄÖ ü " * 40), (18, "😀" * 60 + prose(18, 30)),
        (19, "😀" * 60), (19, "😀" * 60), (20, prose(20)), (20, prose(20)), (None, near), (None, None), (-5, prose(11) + " tail"),
        (21, "<|endoftext|> and </s>"), (22, SHARED[:49]), (23, SHARED[:50]), (24, "\n".join(["same line here"] * 60)),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same as documents, with columns whose names operators use inside."""
    rows = [(d, t, "en", "s", None if t is None else len(t), 1, 2, "k") for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc long, tag long, key string")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
