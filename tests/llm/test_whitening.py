"""Whitening against plain integer loops and numpy."""

import math
import random

import numpy as np
import pytest

from sievewright.llm import whitening


def by_loops(rows, k=8):
    """(n, S, V, eigenvalues, axes) of usable rows, by Python integers."""
    xs = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in rows]
    n, d = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(d)]
    v = np.array([[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in xs) / n**3 for j in range(d)] for i in range(d)])
    e, a = np.linalg.eigh(v)
    return xs, n, s, v, e[::-1][:k], a[:, ::-1][:, :k]


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


@pytest.mark.parametrize("spread", [3, 1000, 1 << 40, 1 << 62])
def test_scatter_is_exact(spread):
    rng = random.Random(spread)
    x = np.array([[rng.randrange(-spread, spread) for _ in range(5)] for _ in range(131)], np.int64)
    x[:, 3] = 7  # a column without planes
    sums, product = whitening.scatter(x)
    rows = x.tolist()
    assert sums.tolist() == [sum(r[i] for r in rows) for i in range(5)]
    assert product.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)]


def test_equals_loops(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(base.astype(np.float32))]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (400, None), (401, []), (402, [0.5] * 11 + [None]), (403, [float("nan")] + [0.1] * 11), (404, [float("inf")] * 12), (405, [-300.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS component", "2 AS n", "'x' AS v")
    got = whitening.whiten(df.repartition(5)).collect()
    kept = [(i, v) for i, v in rows if usable(v)]
    xs, n, s, v, e, axes = by_loops([v for _, v in kept])
    assert n == 303 and len(got) == 8 * n and {r.n for r in got} == {n}
    deviations = sorted(sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)) for x in xs for _ in range(8))
    assert sorted(r.deviation for r in got) == deviations
    assert all(math.isclose(r.distance2 * n * n, r.deviation, rel_tol=1e-12) for r in got)
    for k in range(8):
        mine = sorted((r.vec_id if r.vec_id is not None else -1, r.whitened) for r in got if r.component == k + 1)
        want = sorted(((i if i is not None else -1), float((np.array(x) - np.array(s) / n) @ axes[:, k] / np.sqrt(e[k]))) for (i, _), x in zip(kept, xs, strict=True))
        a, b = np.array([m[1] for m in mine]), np.array([w[1] for w in want])
        assert np.abs(a - b).max() < 1e-7 or np.abs(a + b).max() < 1e-7
        assert {round(r.explained, 12) for r in got if r.component == k + 1} == {round(float(e[k] / np.trace(v)), 12)}
    (error,) = {r.identity_error for r in got}
    assert error < 1e-8


def test_edges(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], kind)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.25, 0.5])], kind)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    # two lengths are two fits; 1e300 stays within 64 bits and its deviation is beyond them
    mixed = whitening.whiten(spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [1e300, 0.0]), (4, [0.0, 0.0]), (5, [0.0, 1.0])], kind)).collect()
    short = {r.vec_id: r for r in mixed if r.n == 2}
    assert {i: (r.deviation, abs(round(r.whitened, 9))) for i, r in short.items()} == {1: (1024**2, 1.0), 2: (1024**2, 1.0)}
    assert {r.deviation for r in mixed if r.n == 3} == {None} and all(math.isfinite(r.distance2) for r in mixed)
