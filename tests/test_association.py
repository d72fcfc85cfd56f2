"""phi_k against brute force, neighbour information against plain loops, odd rows."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tallyloom.operators import information, phik
from tallyloom.operators.selection import MutualInformationSelector


def brute_cells(x, y, rho, steps=3000):
    """Shares by summing the conditional normal over a fine grid of the first margin."""
    from statistics import NormalDist
    n = NormalDist()
    u = (np.arange(steps) + 0.5) / steps
    z = np.array([n.inv_cdf(p) for p in u])
    cuts = np.array([n.inv_cdf(p) for p in np.cumsum(y)[:-1]])
    below = np.array([[0.5 * math.erfc(-(c - rho * a) / math.sqrt(2 * (1 - rho * rho))) for c in cuts] for a in z])
    share = np.diff(np.hstack([np.zeros((steps, 1)), below, np.ones((steps, 1))]), axis=1) / steps
    row = np.searchsorted(np.cumsum(x)[:-1], u)
    return np.array([share[row == i].sum(axis=0) for i in range(len(x))])


@pytest.mark.parametrize("rho", [0.0, 0.3, 0.8, 0.95])
def test_cell_shares_equal_a_plain_sum(rho):
    x, y = np.array([0.2, 0.5, 0.3]), np.array([0.1, 0.4, 0.25, 0.25])
    assert np.abs(phik.normal_cells(x, y, rho) - brute_cells(x, y, rho)).max() < 1e-3


def test_phi_k_finds_the_correlation_of_a_normal(spark):
    rng = np.random.default_rng(1)
    a, e = rng.normal(size=(2, 20_000))
    b = np.clip(0.6 * a + 0.8 * e, -2.5, 2.5)            # equal ends, hence equal margins of both columns
    rows = [(u, v, w, "same", None) for u, v, w in zip(np.clip(a, -2.5, 2.5).tolist(), b.tolist(), rng.normal(size=20_000).tolist())]
    df = spark.createDataFrame(rows, "a double, b double, noise double, one string, none string")
    got = {(r.f1, r.f2): r for r in phik.phi_k_pairs(df, ["a", "b", "noise", "one", "none"]).collect()}
    assert len(got) == 10 and abs(got["a", "b"].phi_k - 0.6) < 0.03 and got["a", "noise"].phi_k < 0.05
    assert got["a", "one"].phi_k is None and got["a", "none"].n == 0
    holes = spark.createDataFrame([(float(i % 3) if i % 4 else None, float("nan") if i % 5 == 0 else i % 3 + 0.0) for i in range(60)],
                                  "a double, b double")
    row = phik.phi_k_pairs(holes, ["a", "b"]).first()
    assert (row.n, row.rows, row.columns) == (36, 3, 3) and row.phi_k > 0.99
    whole = phik.phi_k(np.diag([40.0, 30.0, 30.0]))
    assert whole == pytest.approx(1.0, abs=1e-6) and phik.phi_k(np.full((3, 3), 5.0)) == 0.0
    with pytest.raises(ValueError, match="more than 1 values"):
        phik.phi_k_pairs(spark.createDataFrame([("u", "x"), ("v", "x")], "p string, q string"), ["p", "q"], max_values=1)


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def brute_information(x, y, k):
    keep = [i for i in range(len(x)) if y.count(y[i]) > 1]
    total = 0.0
    for i in keep:
        own = sorted(abs(x[i] - x[j]) for j in keep if j != i and y[j] == y[i])
        d = own[min(k, len(own)) - 1]
        inside = [j for j in keep if (abs(x[i] - x[j]) < d if d else x[i] == x[j])]
        total += digamma(sum(y[j] == y[i] for j in inside)) - digamma(len(inside)) - digamma(y.count(y[i]))
    return max(digamma(len(keep)) + total / len(keep), 0.0)


def test_neighbor_information_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    y = [int(v) for v in rng.integers(0, 3, 150)] + [7, 8, 8]
    x = [[v / 8 + rng.integers(0, 40) / 16, float(rng.integers(0, 5)), 1.0, float(rng.integers(0, 1000)) / 64] for v in y]
    df = spark.createDataFrame([(Vectors.dense(v), label) for v, label in zip(x, y)], ["features", "label"])
    want = [brute_information([v[f] for v in x], y, 3) for f in range(4)]
    for block, limit in ((65_536, None), (7, 20)):       # one block, and many blocks over ranges
        got = {r.feature: r.score for r in information.neighbor_information(df, block=block, limit=limit).collect()}
        assert [got[f] for f in range(4)] == pytest.approx(want, abs=1e-9)
    assert information.neighbor_information(df.where("label > 100")).count() == 0
    kept = MutualInformationSelector(1, estimator="neighbors").fit(df).stages[-1].getIndices()
    assert kept == [int(np.argmax(want))]
    assert len(MutualInformationSelector(2, bins="quantile").fit(df).stages[-1].getIndices()) == 2
    with pytest.raises(ValueError, match="unknown estimator"):
        MutualInformationSelector(1, estimator="guess")
