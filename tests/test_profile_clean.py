import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import clean, profile
from tallyloom.functions.scale import hash_rank, running_total


def test_value_removal_keeps_null_rows(spark):
    df = spark.createDataFrame([("A",), ("?",), (None,)], "y string")
    assert {r[0] for r in clean.remove_instances_with_value(df, "y", "?").collect()} == {"A", None}
    assert clean.remove_instances_with_value(df, "other", "?").count() == 3
    assert [r[0] for r in clean.keep_labelled(df, "y").collect()] == ["A", "?"]


def test_column_removal(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    with pytest.warns(UserWarning, match="zz"):
        assert clean.remove_columns(df, ["a", "b", "zz"], ["b"]).columns == ["b", "c"]
    with pytest.raises(ValueError):
        clean.remove_columns(df, None)
    assert clean.columns_by_regex(df, "^z") is None


def test_required_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    clean.require_columns(df, ["a"])
    with pytest.raises(ValueError, match="'b': 1"):
        clean.require_columns(df, ["a", "b"])
    with pytest.raises(ValueError, match="missing"):
        clean.require_columns(df, ["q"])


def test_constant_column_has_no_correlation_but_is_found(spark):
    df = spark.range(50).select("id", F.lit(3.0).alias("c"), (F.col("id") * 2).alias("x"))
    pairs = {(r["f1"], r["f2"]): r["r"] for r in profile.correlation_pairs(df, ["id", "c", "x"]).collect()}
    assert pairs[("id", "x")] == pytest.approx(1.0) and pairs[("id", "c")] is None
    assert [r[0] for r in profile.constant_columns(df).collect()] == ["c"]


def _by_aggregate(df, a, b):
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    n, va, vb, cov = df.where(both).agg(F.count(F.lit(1)), F.var_pop(a), F.var_pop(b), F.covar_pop(a, b)).first()
    return n, cov / (va * vb) ** 0.5 if va and vb else None


def test_not_a_number_is_missing(spark):
    """The same pair has the same answer beside one column or nine others."""
    df = spark.range(40).select(*[
        F.when(F.col("id") % 7 == i % 7, F.lit(float("nan"))).when(F.col("id") == i, F.lit(float("inf")))
         .otherwise(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100)) + F.col("id")).alias(f"c{i}") for i in range(10)])
    known = df.select(*[F.when(F.isnan(c) | (F.col(c) > 1e300), None).otherwise(F.col(c)).alias(c) for c in df.columns])
    two = profile.correlation_pairs(df, ["c0", "c3"]).first()
    ten = [r for r in profile.correlation_pairs(df, df.columns).collect() if (r["f1"], r["f2"]) == ("c0", "c3")][0]
    n, r = _by_aggregate(known, "c0", "c3")
    assert two["n"] == ten["n"] == n < 40 and two["r"] == pytest.approx(r) and ten["r"] == pytest.approx(r)


def test_correlations_equal_aggregates(spark):
    df = spark.range(500).select(
        *[F.when(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(9)) > 0,
                 F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(1000)) / 7 + F.col("id") * i).alias(f"c{i}")
          for i in range(6)], F.lit(2.0).alias("c6"))
    a = {(i, j): _by_aggregate(df, f"c{i}", f"c{j}") for i in range(7) for j in range(i + 1, 7)}
    b = {(r["i"], r["j"]): (r["n"], r["r"]) for r in profile.correlation_pairs(df, df.columns).collect()}
    assert a.keys() == b.keys() and len(a) == 21
    for k in a:
        assert a[k][0] == b[k][0]
        assert a[k][1] == pytest.approx(b[k][1], abs=1e-9) if a[k][1] is not None else b[k][1] is None


def test_pruning_directions(spark):
    rows = [(float(i), 2.0 * i + (i % 3), 10.0 * (i // 10) + 0.1 * i, "ab"[i >= 10]) for i in range(20)]
    df = spark.createDataFrame(rows, "f1 double, f2 double, f3 double, y string")
    strong = {r["feature"]: r["eta"] for r in profile.correlation_ratio(df, "y", ["f1", "f2", "f3"]).collect()}
    assert strong["f3"] > strong["f1"]
    higher = {r[0] for r in clean.highly_correlated(df, "y", 0.85, "higher").collect()}
    lower = {r[0] for r in clean.highly_correlated(df, "y", 0.85, "lower").collect()}
    assert "f3" not in higher and "f3" in lower
    assert set(clean.remove_highly_correlated(df, clean.highly_correlated(df, "y", 0.85)).columns) == \
        set(df.columns) - higher


def test_low_variance_with_text_and_low_threshold(spark):
    df = spark.range(100).select(F.when(F.col("id") < 97, "a").otherwise("b").alias("t"),
                                 (F.col("id") % 2).alias("half"), F.col("id").alias("many"))
    assert {r["feature"]: r["share"] for r in profile.low_variance_columns(df).collect()} == {"t": 0.97}
    assert {r["feature"] for r in profile.low_variance_columns(df, 0.5).collect()} == {"t", "half"}


def _tau(x, y):
    s = sum(np.sign(a - c) * np.sign(b - d) for (a, b), (c, d) in itertools.combinations(zip(x, y), 2))
    n0 = len(x) * (len(x) - 1) / 2
    tx = sum(c * (c - 1) / 2 for c in np.unique(x, return_counts=True)[1])
    ty = sum(c * (c - 1) / 2 for c in np.unique(y, return_counts=True)[1])
    return s / math.sqrt((n0 - tx) * (n0 - ty))


@pytest.mark.parametrize("limit", [None, 5])
def test_rank_associations(spark, limit):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, 150)
    y = x * 0.5 + rng.integers(0, 9, 150)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    row = profile.pair_associations(df, [("x", "y")], limit).first()
    rank = lambda v: np.array([np.mean(np.flatnonzero(np.sort(v) == a)) for a in v])
    assert row["kendall"] == pytest.approx(_tau(x, y))
    assert row["spearman"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


@pytest.mark.parametrize("limit", [None, 10])
def test_exact_quantiles(spark, limit):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=201).round(2), "b": rng.integers(0, 4, 201).astype(float)}
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(data["a"], data["b"])], "a double, b double")
    got = {r["feature"]: r["q"] for r in profile.exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.9], limit).collect()}
    for c, v in data.items():
        assert got[c] == pytest.approx(list(np.quantile(v, [0.25, 0.5, 0.9])))


def test_running_total_and_hash_rank_on_one_big_group(spark):
    df = spark.range(300).select("id", F.lit("g").alias("g"), (F.col("id") % 5).alias("w"))
    plain = {r["id"]: r["t"] for r in running_total(df, ["g"], ["id"], "t", "w").collect()}
    cut = {r["id"]: r["t"] for r in running_total(df, ["g"], ["id"], "t", "w", limit=10).collect()}
    assert plain == cut
    ranks = sorted(r["_rank"] for r in hash_rank(df, "id", 1, ["g"]).collect())
    assert ranks == list(range(1, 301))
    assert {r["id"]: r["_rank"] for r in hash_rank(df, "id", 1, ["g"], digits=1).collect()} == \
        {r["id"]: r["_rank"] for r in hash_rank(df.repartition(7), "id", 1, ["g"], digits=3).collect()}
