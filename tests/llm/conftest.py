import random

import pytest


def texts(seed=3, n=60):
    """Prose of invented words with copies, near copies, shared passages, repeated lines."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    shared = "\n".join(line(14) for _ in range(6))
    out = []
    for i in range(n):
        body = [line(rng.randint(6, 20)) for _ in range(rng.randint(1, 9))]
        if i % 7 == 0:
            body.insert(len(body) // 2, shared)
        out.append("\n".join(body))
    for i in range(0, n, 6):
        out.append(out[i])
        w = out[i].split(" ")
        if len(w) > 40:
            w[20] = "changed"
        out.append(" ".join(w))
    return out


EDGES = [None, "", " ", "one", "a b c d", "x" * 700, "ab " * 400, "Grüße 😀 " * 50, "l1\n\n\nl2\n" * 30]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts() + EDGES)]
    rows += [rows[0], rows[3], (None, "no id here at all, none"), (5, "another text under a used id")]
    return spark.createDataFrame([(*r, "clash", 1, 2.0) for r in rows], "doc_id long, text string, key string, h int, score double").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
