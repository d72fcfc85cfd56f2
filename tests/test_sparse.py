"""Sparse vectors of wide nominal columns, into selectors and models."""

import pytest
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from tallyloom.operators import prep
from tallyloom.operators.search import create_pipeline
from tallyloom.plans import jobs


def test_sparse_vectors_equal_dense_ones(spark):
    rows = [(i, float(i % 4), float(i), ["a", "b", None, "c"][i % 4], ["x", "y"][i % 2], ["lo", "hi"][i % 2], "keep") for i in range(12)]
    df = spark.createDataFrame(rows, "k long, u double, v double, n string, m string, o string, rest string")
    made = prep.DataEncoder(["u", "v"], ["n", "m"], {"o": ["lo", "hi"]}, scaling="none").fit(df)
    dense = {r.k: r.features for r in prep.to_vector(made.transform(df), made.output_columns).collect()}
    got = made.sparse_vectors(df, "k").collect()
    assert len(got) == 12 and all(isinstance(r.features, SparseVector) and r.rest == "keep" for r in got)
    assert all(Vectors.dense(r.features.toArray()) == dense[r.k] for r in got)
    assert len(made.sparse_columns()) == len(made.output_columns)
    unseen = spark.createDataFrame([(1, 0.0, 0.0, "new", "x", "lo", "keep")], df.schema)
    assert made.sparse_vectors(unseen, "k").first().features.numNonzeros() == 0
    bad = spark.createDataFrame([(1, None, 0.0, "a", "x", "lo", "keep")], df.schema)
    with pytest.raises(Exception, match="null in feature column u"):
        made.sparse_vectors(bad, "k").collect()


def test_rows_of_narrow_columns_are_not_shuffled(spark, monkeypatch):
    """All rows of a frequent value would meet in one task; wide columns alone are joined by shuffle."""
    df = spark.range(3000).selectExpr("id as k", "concat('w', id % 900) as wide", "if(id % 10 = 0, 'rare', 'usual') as narrow")
    monkeypatch.setattr(prep, "BROADCAST_ROWS", 100)
    enc = prep.DataEncoder(nominal=["wide", "narrow"]).fit(df)
    got = {(r["key"], r["index"]) for r in enc.sparse(df, "k").collect()}
    codes = {v: i for i, v in enumerate(sorted({f"w{i}" for i in range(900)}))}
    want = {(i, codes[f"w{i % 900}"] - 1) for i in range(3000) if codes[f"w{i % 900}"]}
    assert got == want | {(i, 899) for i in range(3000) if i % 10}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = enc.sparse(df, "k")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1
        plan = prep.DataEncoder(nominal=["narrow"]).fit(df).sparse(df, "k")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_model_on_a_hundred_thousand_categories(spark):
    df = spark.range(150_000).selectExpr(
        "id as id_log", "id % 500 as x", "concat('c', id % 119000) as wide", "if(id % 119000 < 60000, 'low', 'high') as target")
    s = jobs.Settings(target="target", key="id_log", group=None, test_size=0.15, val_size=None, folds=2, balance=None,
                      numerical_strategy="mean")
    p = jobs.prepare(df, s)
    first = p.data.select("features").first().features
    assert isinstance(first, SparseVector) and len(first) == len(p.feature_names) > 100_000 and first.numNonzeros() <= 2
    train = p.data.where("split = 'train'")
    model = create_pipeline("Logistic Regression", "none", {"classifier__C": 1e6, "classifier__max_iter": 10}).fit(train)
    hits = model.transform(train).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert hits > 0.9
