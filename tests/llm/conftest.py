import random

import pytest

WORDS = ["the", "of", "and", "alpha", "beta", "gamma", "delta", "straße", "naïve", "über", "señor", "Ωmega", "中文", "x1", "42", "don't", "it's"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(id, text) with nulls, empties, ties, repeated rows, copies, near copies, shared passages and a long text."""
    rng = random.Random(11)
    passage = prose(rng, 70)
    rows = [(k, prose(rng, rng.randint(1, 120))) for k in range(40)]
    rows += [(40 + k, f"{prose(rng, 10)} {passage} {prose(rng, 12)}") for k in range(5)]
    rows += [(50, None), (51, ""), (52, " "), (53, "\t \n"), (None, "nobody's text"), (None, None), (3, rows[3][1]), (3, rows[3][1]), (7, "other text of an id that repeats")]
    base = prose(rng, 300).split(" ")
    for k in range(6):
        words = list(base)
        for _ in range(k):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((60 + k, " ".join(words)))
    rows += [(70 + k, rows[5][1].replace(" ", "  " if k % 2 else "\t")) for k in range(4)]
    rows += [(80, prose(rng, 6000)), (81, "a" * 5000), (82, "ab" * 300), (83, "é" * 400)]
    return rows


@pytest.fixture(scope="session")
def frame(spark, corpus):
    """The corpus with columns whose names clash with the operators' own."""
    rows = [(i, t, None if i is None else i % 3, "c", 0, 1.5, None) for i, t in corpus]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id long, kept string, shard int, score double, spans string")
    return df.repartition(5, "doc_id", "text").cache()


@pytest.fixture(scope="session")
def empty(frame):
    return frame.filter("doc_id = -1")
