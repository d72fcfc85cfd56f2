"""Spark jobs that one fit of a sweep needs, and the counts that replaced exploded components."""

import math
import uuid

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallyloom.operators import selection
from tallyloom.operators.models import Classifier
from tallyloom.operators.search import create_pipeline

NAN = float("nan")
ROWS = [[float(i % 7), float(i * i % 11) / 3 - 1, 4.0, NAN if i % 5 == 0 else float(i % 3), NAN] for i in range(90)]
LABELS = [None if i % 13 == 0 else i % 7 // 3 for i in range(90)]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(Vectors.dense(x), y) for x, y in zip(ROWS, LABELS)]
    df = spark.createDataFrame(data, ["features", "label"]).withColumn("label", F.col("label").cast("int"))
    df = df.repartition(4).cache()
    df.count()
    return df


def jobs_of(spark, work) -> int:
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def expected(x, y, bins=10) -> float:
    known = [(a, c) for a, c in zip(x, y) if c is not None]
    real = [a for a, _ in known if not math.isnan(a)]
    lo, width = (min(real), max(real) - min(real)) if real else (0.0, 0.0)
    cells = {}
    for a, c in known:
        b = 0 if width == 0 or math.isnan(a) else min(math.floor((a - lo) * bins / width), bins - 1)
        cells[b, c] = cells.get((b, c), 0) + 1
    n = len(known)
    n_b = {b: sum(v for (i, _), v in cells.items() if i == b) for b, _ in cells}
    n_c = {c: sum(v for (_, j), v in cells.items() if j == c) for _, c in cells}
    return sum(v / n * math.log(v * n / (n_b[b] * n_c[c])) for (b, c), v in cells.items())


@pytest.mark.parametrize("at_once", [1_000_000, 7])
@pytest.mark.parametrize("kind", ["int", "double", "string"])
def test_counted_bins_give_the_mutual_information(rows, monkeypatch, at_once, kind):
    monkeypatch.setattr(selection, "CELLS_AT_ONCE", at_once)
    df = rows.withColumn("label", F.col("label").cast(kind))
    found = {r["feature"]: r["score"] for r in selection.mutual_information(df).collect()}
    wanted = {j: expected([x[j] for x in ROWS], LABELS) for j in range(5)}
    assert found == pytest.approx(wanted, abs=1e-12)


def test_a_fit_of_the_sweep_needs_few_jobs(spark, rows):
    known = rows.where("label is not null").select(F.col("label"), F.col("features"))
    assert jobs_of(spark, lambda: selection.MutualInformationSelector(k=2).fit(known)) <= 6
    clean = spark.createDataFrame([(Vectors.dense([float(i % 3), float(i)]), i % 2) for i in range(40)],
                                  ["features", "label"]).cache()
    clean.count()
    assert jobs_of(spark, lambda: Classifier("Naive Bayes").fit(clean)) <= 2
    model = create_pipeline("Naive Bayes", "mi", {"selector__k": 1}).fit(clean)
    assert model.transform(clean).where("prediction is not null").count() == 40


def test_naive_bayes_without_known_labels_fails(rows):
    with pytest.raises(ValueError):
        Classifier("Naive Bayes").fit(rows.where("label is null"))


def test_naive_bayes_scores_are_log_densities(rows):
    two = [(Vectors.dense([float(i % 4), float(i % 3)]), i % 2 * 2) for i in range(30)]      # class 1 never occurs
    df = rows.sparkSession.createDataFrame(two, ["features", "label"])
    got = Classifier("Naive Bayes", {"var_smoothing": 1e-3}).fit(df).transform(df).collect()
    x, y = np.array([v.toArray() for v, _ in two]), np.array([c for _, c in two])
    smooth = 1e-3 * x.var(axis=0).max()
    score = np.array([[-np.inf if not (y == c).any() else math.log((y == c).mean()) - 0.5 * float((np.log(
        2 * math.pi * (x[y == c].var(axis=0) + smooth)) + (v - x[y == c].mean(axis=0)) ** 2 / (
        x[y == c].var(axis=0) + smooth)).sum()) for c in range(3)] for v in x])
    p = np.exp(score - score.max(axis=1, keepdims=True))
    by_row = {(tuple(r["features"].toArray()), r["label"]): r["probability"].toArray() for r in got}
    for v, c, want in zip(x, y, p / p.sum(axis=1, keepdims=True)):
        assert by_row[tuple(v), c] == pytest.approx(want, abs=1e-9)
