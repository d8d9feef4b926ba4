"""Whitening against numpy on small tables, and the refinement on matrices with close eigenvalues."""

import math

import numpy as np
import pytest

from driftengine.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(120, 12)) @ np.diag(np.linspace(3, 0.2, 12))).astype(np.float32).tolist()
    copies = [base[3]] * 30  # copies do not count in the fit
    odd = [None, [], [1.0] * 5, [None] + [0.0] * 11, [math.nan] + [0.0] * 11, [math.inf] + [0.0] * 11, [1e30] + [0.0] * 11]
    return [*enumerate(base + copies + odd), (None, base[0]), (0, base[0])]


def test_whiten(spark, rows):
    usable = [(i, v) for i, v in rows
              if v is not None and len(v) == 12 and all(c is not None and abs(c) < 1e20 for c in v)]
    x = {i: np.floor(np.array(v, float) * 64).astype(np.int64) + 1_000_000 for i, v in usable}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    mean = fit.mean(axis=0)
    e, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, axes = e[::-1], axes[:, ::-1]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 12 * len(usable)
    signs = {}
    for r in got:
        row = x[r.vec_id]
        assert r.n == n and r.deviation == sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums))
        k = r.component - 1
        want = (row - mean) @ axes[:, k] / math.sqrt(e[k])
        signs.setdefault(k, np.sign(r.whitened * want))
        assert r.whitened == pytest.approx(signs[k] * want, abs=1e-9)
        assert r.explained == pytest.approx(e[k] / e.sum(), rel=1e-9) and r.identity_error < 1e-9


def test_does_not_depend_on_partitions(spark, rows):
    one, many = (sorted(tuple(r) for r in whitening.whiten(frame(spark, rows[:150]).repartition(p)).collect()) for p in (1, 9))
    # The axes are the same ones; a projection's last digits depend on how many rows are projected at once.
    assert [r[:4] + r[5:6] for r in one] == [r[:4] + r[5:6] for r in many]
    assert np.allclose([r[4] for r in one], [r[4] for r in many], rtol=0, atol=1e-13)


def test_without_variance(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()
    assert len(got) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {
        (1, 0, None, None, None)}
    got = whitening.whiten(frame(spark, [(1, [0.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.component, r.whitened) for r in got} == {(1, 1.0), (1, -1.0), (2, None)}
    assert {r.explained for r in got} == {1.0, 0.0} and {r.identity_error for r in got} == {0.0}


def test_empty(spark, rows):
    assert whitening.whiten(frame(spark, rows).limit(0)).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []


def test_large_deviation_is_null():
    x = np.array([[2 ** 52, 0], [3, 4]])
    assert whitening.deviations(x, 2, np.array([0, 0])) == [None, 100]


def test_refinement_of_close_eigenvalues():
    wide = np.longdouble
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0].astype(wide)
    for _ in range(4):
        q = q @ (1.5 * np.eye(20, dtype=wide) - 0.5 * (q.T @ q))
    values = np.array([5, 5, 5, 3 + 2e-9, 3 + 1e-9, 3, 2, 1] + [0.5 - 0.01 * i for i in range(12)], wide)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.eigenvectors(a)
    assert np.abs(x.T @ x - np.eye(20)).max() < 1e-17 and np.abs(a @ x - x * e).max() < 1e-16
    assert np.abs(e - values).max() < 1e-17
    # Single eigenvalues: the vectors themselves, those 1e-9 apart too, which float32 cannot tell apart.
    assert (1 - np.abs((q * x).sum(axis=0))[3:]).max() < 1e-14
    plain = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    assert (1 - np.abs((q * plain).sum(axis=0))[3:6]).max() > 1e-3
