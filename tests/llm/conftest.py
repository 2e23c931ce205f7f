import random

import pytest

#: Texts with nulls, empties, ties, repeated rows, one very long text and shared passages.
WORDS = "the of and to in is was for on with as by at from that this are be or an quick brown fox lazy dog jumps over river stone paper light".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    rng = random.Random(4)
    base, passage = prose(rng, 120), prose(rng, 70)
    rows = [(i, prose(rng, rng.randrange(1, 90)), rng.choice(["a", "b", None])) for i in range(40)]
    for i in range(40, 60):  # near copies
        words = base.split(" ")
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words), "a"))
    rows += [(60 + i, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 20), "b") for i in range(8)]
    rows += [(70, None, None), (71, "", "a"), (72, "   \n\t ", "a"), (73, "one", "b"), (74, "ONE", "b"), (75, "Two words", "b"), (76, "two WORDS", None)]
    rows += [(80, prose(rng, 9000), "a"), (81, "x" * 5000, "a"), (82, "x" * 5000, "b"), (90, base, "a"), (90, base, "a"), (91, "é" * 300, "a")]
    rows += [(None, base, "a"), (None, None, None)]
    # extra columns with names that operators use inside
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, source string, id string, h int, n int")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
