"""Whitening against numpy's eigenvectors of the covariance, and exact sums against whole numbers."""

import math
import random

import numpy as np
import pytest

from emberlog.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string, n string"


def table(spark, rows):
    return spark.createDataFrame([(k, v, "clash", "n") for k, v in rows], SCHEMA)


def check(spark, rows, count, parts=5):
    got = whitening.whiten(spark, table(spark, rows).repartition(parts), count=count).collect()
    good = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d, n = len(good[0][1]), len(good)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good], object)
    sums = [int(s) for s in x.sum(axis=0)]
    gap = (n * x - np.array(sums, object)).tolist()
    centred = np.array([[g / n for g in row] for row in gap])
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    e, vec = e[::-1], vec[:, ::-1]
    k = min(count, d)
    assert len(got) == n * k
    want = {(key, c + 1): (dev, w) for (key, _), dev, row in zip(good, [sum(g * g for g in r) for r in gap], centred @ vec[:, :k] / np.sqrt(e[:k]), strict=True) for c, w in enumerate(row.tolist())}
    sign = {}
    for r in got:
        dev, w = want[r.vec_id, r.component]
        assert r.n == n and r.deviation == (dev if dev < 1 << 63 else None)
        if abs(w) > 1e-3:
            assert sign.setdefault(r.component, math.copysign(1, w * r.whitened)) == math.copysign(1, w * r.whitened)
        assert abs(abs(w) - abs(r.whitened)) < 1e-6
        assert math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9)
        assert 0 <= r.identity_error < 1e-9


def test_equals_eigenvectors(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(9, 9)) * np.geomspace(3, 0.2, 9)
    rows = [(i, (rng.normal(size=9) @ mix).tolist()) for i in range(400)]
    rows += [(1000, None), (1001, [None] * 9), (1002, [math.nan] * 9), (1003, [math.inf] + [0.0] * 8), (1004, [])]
    check(spark, rows, 32)
    check(spark, rows, 4, parts=60)  # more triangles than one task folds


def test_enormous_entries_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**50, rng.uniform(-1, 1) * 2.0**50, rng.uniform(-1, 1) * 2.0**50]) for i in range(60)]
    check(spark, rows, 3)
    check(spark, [(i, [rng.uniform(-9, 9), rng.uniform(-1, 1) * 2.0**28]) for i in range(50)], 2)


def test_no_variance_and_odd_lengths(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 2.5]), (4, [7.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])]
    got = whitening.whiten(spark, table(spark, rows)).collect()
    assert len(got) == 10 and {r.vec_id for r in got} == {1, 2, 3, None}
    assert all((r.whitened is None) == (r.component == 2) for r in got)
    assert {r.explained for r in got} == {1.0, 0.0} and got[0].identity_error < 1e-9
    one = whitening.whiten(spark, table(spark, [(5, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 2


def test_empty(spark):
    assert whitening.whiten(spark, table(spark, [])).count() == 0
    assert whitening.whiten(spark, table(spark, [(1, None)])).columns[0] == "vec_id"


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_rotations_equal_svd(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d + 3, d)) * np.geomspace(1, 1e-8, d)
    r = np.linalg.qr(a, mode="r")
    values, v = whitening.jacobi(r)
    assert np.allclose(values, np.linalg.svd(a)[1], rtol=1e-6)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-12)
    assert np.allclose(np.abs(r @ v).T @ np.abs(r @ v) if d == 1 else (r @ v).T @ (r @ v), np.diag(values**2), atol=1e-12)
