"""Components: how many rounds they take."""

import random

from voltlake.llm import components


def rounds(monkeypatch, spark, edges):
    made = []
    real = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df: (made.append(1), real(df))[1])
    got = {r.vertex: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    monkeypatch.setattr(components, "materialise", real)
    return len(made) - 1, got


def test_stars_take_no_round(spark, monkeypatch):
    stars = [(10 * c + k, 10 * c) for c in range(5) for k in range(1, 8)]
    n, got = rounds(monkeypatch, spark, stars)
    assert n == 0 and got == {v: v // 10 * 10 for u, c in stars for v in (u, c)}


def test_no_round_after_the_last_change(spark, monkeypatch):
    n, got = rounds(monkeypatch, spark, [(1, 2), (2, 3)])
    assert n == 1 and got == {1: 1, 2: 1, 3: 1}
    assert rounds(monkeypatch, spark, [(3, 1), (3, 2)])[1] == {1: 1, 2: 1, 3: 1}  # two edges up, none of them up and down
    ring = [(k, (k + 1) % 40) for k in range(40)]
    random.Random(1).shuffle(ring)
    assert set(rounds(monkeypatch, spark, ring)[1].values()) == {0}
