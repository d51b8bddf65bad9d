"""Whitening against numpy's own eigenvectors, with odd rows; the divide-and-conquer on spectra that are hard to part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component string"


def rows(n=400, width=24, seed=3):
    draw = np.random.default_rng(seed)
    mix = draw.normal(size=(width, width)) * np.logspace(0, -1.5, width)
    out = [(i, (draw.normal(size=width) @ mix).astype(np.float32).tolist(), 1, "clash") for i in range(n)]
    out += [out[0]] * 30 + [(n + i, out[1][1], None, None) for i in range(50)]  # repeats weigh nothing
    bad = [None, [], [None] * width, [float("nan")] * width, [float("inf")] * width, [1e30] * width]
    return out + [(None, out[2][1], 1, "x")] + [(2000 + i, b, 1, "") for i, b in enumerate(bad)]


def brute(rows, most=16):
    own = [(i, tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in e)) for i, e, *_ in rows if e and None not in e and np.isfinite(e).all() and max(map(abs, e)) < 2**56]
    fit = np.array(sorted({x for _, x in own}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    z = np.array([[(n * int(c) - int(s)) / n for c, s in zip(x, sums)] for x in fit])
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    out = {}
    for i, x in own:
        deviation = sum((n * c - int(s)) ** 2 for c, s in zip(x, sums))
        w = np.array([(n * c - int(s)) / n for c, s in zip(x, sums)]) @ u / np.sqrt(e)
        out.setdefault(i, []).append((n, deviation, w, e / np.trace(v)))
    return out


@pytest.mark.parametrize("width", [24, 5])
def test_as_brute_force(spark, width):
    data = rows(width=width)
    got = whitening.whitening(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    want = brute(data)
    k = min(width, 16)
    assert len(got) == k * sum(map(len, want.values()))
    signs = {}
    for r in got:
        n, deviation, w, explained = want[r["vec_id"]][0]
        assert (r["n"], r["deviation"]) == (n, deviation)
        mine, theirs = r["whitened"], w[r["component"] - 1]
        if abs(theirs) > 0.01:
            assert signs.setdefault(r["component"], np.sign(mine * theirs)) == np.sign(mine * theirs)
        assert abs(mine) == pytest.approx(abs(theirs), abs=1e-8)
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert {r["component"] for r in got} == set(range(1, k + 1))


def test_few_and_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitening(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")], SCHEMA)
    assert whitening.whitening(one).count() == 0  # no variance
    two = spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [2.0, 2.0], 0, ""), (3, [1.0], 0, ""), (4, [5.0], 0, "")], SCHEMA)
    got = {(r["vec_id"], r["component"]): (r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in whitening.whitening(two).collect()}
    assert got == {(1, 1): (2, 64**2, 1.0, 1.0), (2, 1): (2, 64**2, 1.0, 1.0), (3, 1): (2, 256**2, 1.0, 1.0), (4, 1): (2, 256**2, 1.0, 1.0)}


def test_exact_beyond_64_bits(spark):
    data = [(i, [float(v), 0.0], 0, "") for i, v in enumerate([2.0**55, -(2.0**55), 0.0])]
    got = whitening.whitening(spark.createDataFrame(data, SCHEMA)).where(F.col("component") == 1).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {0: None, 1: None, 2: 0}


@pytest.mark.parametrize("width", [1, 2, 7, 40])
def test_spectra(width):
    draw = np.random.default_rng(width)
    q, _ = np.linalg.qr(draw.normal(size=(width, width)))
    half = width // 2
    for values in (draw.uniform(1, 100, width), np.r_[np.full(half, 3.0), draw.uniform(1, 2, width - half)], np.logspace(0, -12, width), np.full(width, 7.0), np.r_[np.zeros(half), draw.uniform(1, 2, width - half)], np.r_[1000, draw.uniform(1, 1.001, width - 1)], np.zeros(width)):
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        got, u = whitening.spectrum(a, 16)
        want = np.linalg.eigvalsh(a)[::-1][:16]
        assert np.abs(got - want).max() <= 1e-13 * max(np.abs(want).max(), 1e-300)
        assert np.abs(a @ u - u * got).max() <= 1e-13 * max(np.abs(a).max(), 1e-300)
        assert np.abs(u.T @ u - np.eye(u.shape[1])).max() < 1e-12
        assert (np.diff(got) <= 0).all()


def test_polar_factor():
    a = np.diag([5.0, 1e-9, -3.0, -1e-12])
    assert np.abs(whitening.polar_sign(a) - np.diag([1.0, 1.0, -1.0, -1.0])).max() < 1e-10
