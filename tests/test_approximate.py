"""The approximate neighbour join against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import approximate, neighbors, prep
from tallyloom.operators.neighbors import _side


def _clouds(spark, n, seed=1, holes=0.0):
    """Rows on a curved sheet of three free coordinates in 16 dimensions, two classes."""
    rng = np.random.default_rng(seed)
    free = rng.uniform(-1, 1, (n, 3))
    x = np.tanh(free @ np.random.default_rng(7).normal(size=(3, 16))) + rng.normal(0, 0.01, (n, 16))
    x[rng.random(x.shape) < holes] = np.nan
    rows = [(i, i % 2, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "key long, label int, vec array<double>").repartition(4, "key")


def _share(approx, exact):
    both = approx.select("q_key", "target", "d_key").intersect(exact.select("q_key", "target", "d_key")).count()
    return both / exact.count()


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_recall_is_kept(spark, metric):
    df = _clouds(spark, 3000)
    side = _side(df, "key", "vec", "label", "label")
    exact = neighbors.nearest(side, side, 5, metric, exclude_self=True)
    got = neighbors.nearest(side, side, 5, metric, exclude_self=True, recall=0.9, leaf=64).cache()
    assert _share(got, exact) >= 0.9
    assert got.groupBy("q_key").count().where("count = 5").count() == 3000
    same = got.alias("a").join(exact.alias("b"), ["q_key", "d_key"]).where("abs(a.distance - b.distance) > 1e-9")
    assert same.count() == 0
    blocks = df.select("key", "label")
    assert (got.join(blocks.toDF("q_key", "a"), "q_key").join(blocks.toDF("d_key", "b"), "d_key")
            .where("a <> b").count()) == 0


def test_comparisons_grow_slowly(spark):
    def work(n):
        side = _side(
            _clouds(spark, n), "key", "vec", None, None)
        forest = approximate.grow(side, leaf=64)
        leaves = forest.leaves(side).cache()
        probes = approximate.probes_for(forest, side, side, leaves, 5, "euclidean", True, 0.9)
        cells = leaves.groupBy(*approximate.CELL).agg(F.count(F.lit(1)).alias("n"))
        assert cells.agg(F.max("n")).first()[0] < 3 * 64
        return forest.routed(side, probes).join(cells, approximate.CELL).agg(F.sum("n")).first()[0]
    small, large = work(2000), work(16_000)
    assert large < 16 * small              # all pairs would be 64 times as many
    assert large < 16_000 ** 2 / 8


def test_holes_are_asked_of_donors_that_know(spark):
    df = _clouds(spark, 1500, holes=0.05)
    names = [f"c{i}" for i in range(16)]
    wide = df.select("key", *[F.get("vec", F.lit(i)).alias(c) for i, c in enumerate(names)])
    exact = prep.DataImputer(knn_neighbors=3, key="key").fit(wide)
    loose = prep.DataImputer(knn_neighbors=3, key="key", recall=0.9, leaf=128).fit(wide)
    a, b = exact.neighbors(wide), loose.neighbors(wide).cache()
    assert b.groupBy("q_key", "target").count().where("count <> 3").count() == 0
    assert b.where("payload is null or isnan(payload)").count() == 0
    assert _share(b, a) >= 0.85


def test_edges(spark):
    df = _clouds(spark, 40)
    side = _side(df, "key", "vec", "label", None)
    none = side.limit(0)
    assert neighbors.nearest(none, side, 3, recall=0.9).count() == 0
    assert neighbors.nearest(side, none, 3, recall=0.9).count() == 0
    # classes smaller than k, copies without end and an unknown class
    copies = spark.range(5000).select(F.col("id").alias("key"), F.lit("a").alias("block"), F.lit(-1).alias("target"),
                                      F.lit(0.0).alias("payload"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    few = spark.createDataFrame([(-1, "b", -1, 0.0, [0.0, 0.0]), (-2, "b", -1, 0.0, [1.0, 0.0]), (-3, "c", -1, 0.0, [1.0, 1.0])],
                                copies.schema)
    both = copies.unionByName(few)
    got = {(r["q_key"], r["rank"]): (r["d_key"], r["distance"])
           for r in neighbors.nearest(both, both, 3, exclude_self=True, recall=0.9, leaf=32).collect()}
    assert got[-1, 1] == (-2, 1.0) and got[-2, 1] == (-1, 1.0) and (-3, 1) not in got and (-1, 2) not in got
    assert [got[7, r] for r in (1, 2, 3)] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    with pytest.raises(ValueError, match="between"):
        neighbors.nearest(both, both, 3, recall=1.5)
    with pytest.raises(ValueError, match="leaf"):
        neighbors.nearest(both, both, 3, leaf=10)


def test_buckets_that_cost_more_than_a_scan_are_not_followed(spark, monkeypatch):
    """Vectors without structure: calibration stops at the affordable probes, and the answer is the exact one."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(3000, 32)))]
    side = _side(spark.createDataFrame(rows, "key long, vec array<double>"), "key", "vec", None, None)
    forest = approximate.grow(side, leaf=16)
    assert forest.affordable < forest.most
    leaves = forest.leaves(side).cache()
    assert approximate.probes_for(forest, side, side, leaves, 5, "euclidean", True, 0.9, most=forest.affordable) is None
    written = []
    store = approximate.materialise
    monkeypatch.setattr(approximate, "materialise", lambda df, name="table": (written.append(name), store(df, name))[1])
    got = neighbors.nearest(side, side, 5, exclude_self=True, recall=0.9, leaf=16)
    assert "routed" not in written
    assert _share(got, neighbors.nearest(side, side, 5, exclude_self=True)) == 1.0
    structured = _side(_clouds(spark, 3000), "key", "vec", None, None)
    neighbors.nearest(structured, structured, 5, exclude_self=True, recall=0.9, leaf=64)
    assert "routed" in written
