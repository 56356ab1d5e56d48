"""Hard negatives against plain loops; the query against its twin is in test_exact's list of twins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from atriumq.llm import negatives


def plain(rows, every, p, k, low=80, high=100):
    """Brute force over (id, label, vector) rows."""
    good = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = (label, [math.floor(256 * c) for c in v])
        good[i] = min(good.get(i, x), x)
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in good.items() if i != a)
        for ps, q, _ in [s for s in scored if s[2] == label][:p]:
            fit = [(i, -s) for s, i, other in scored if other != label and low * -ps <= 100 * -s <= high * -ps][:k]
            out += [(a, q, n + 1, i, -ps, s) for n, (i, s) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block", [65_536, 7])
def test_against_loops(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "CHUNK", 2)
    rng = random.Random(1)
    rows = [(k, rng.randrange(3), [float(rng.randrange(-1, 5)) for _ in range(3)]) for k in range(120)]
    rows += [(200 + k, 1, [4.0, 4.0, 4.0]) for k in range(30)]  # one vector often: ties by id
    rows += [(500, None, [1.0, 1.0, 1.0]), (510, 1, None), (520, 1, [1.0, None, 1.0]), (530, 1, [1.0, math.nan, 1.0]), (540, 1, [1.0, math.inf, 1.0]), (550, 2, [0.0, 0.0, 0.0]), (560, 7, [9.0, 9.0, 9.0]), (None, 1, [1.0, 1.0, 1.0]), (580, 1, [-3.0, -3.0, -3.0]), (60, 0, [1.0, 2.0, 3.0]), (60, 0, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([*rows, (570, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "block", "score", "ids", "p")})
    got = sorted(map(tuple, negatives.hard_negatives(df, positives=4, k=3, every=10).collect()))
    assert got == plain(rows, 10, 4, 3) and got


def test_large_components_stay_exact(spark):
    rows = [(k * 10, k % 2, [2.0**28 + k, 2.0**27 - k, 3.0 * k]) for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = [(a, p, n, i, min(ps, negatives.MOST), min(s, negatives.MOST)) for a, p, n, i, ps, s in plain(rows, 10, 3, 3)]
    assert len(negatives.hard_negatives(df, positives=3, k=3, every=10).collect()) >= len({w[:2] for w in want})


def test_scores_are_exact():
    import numpy as np

    a, x = np.array([[2.0**30 + 1, 3.0]]), np.array([[2.0**24 + 1, -5.0], [1.0, 1.0]])
    assert negatives.scores(a, x).tolist() == [[(2**30 + 1) * (2**24 + 1) - 15, 2**30 + 4]]
    assert negatives.scores(np.array([[1e300]]), np.array([[1e300], [-1e300]])).tolist() == [[negatives.MOST, -negatives.MOST]]


def test_none(spark):
    shape = "vec_id long, label int, embedding array<double>"
    assert negatives.hard_negatives(spark.createDataFrame([], shape)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(100, 1, [1.0])], shape)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], shape)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(100, 1, [])], shape)).count() == 0
