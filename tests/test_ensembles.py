"""Joint boosting, bootstrap forests and calibrated margins."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallyloom.operators import calibration
from tallyloom.operators.boosting import BootstrapForest, SoftmaxBoosting, SoftmaxBoostingModel, BootstrapForestModel
from tallyloom.operators.fitting import drawn_columns, flatten
from tallyloom.operators.models import Classifier
from tallyloom.operators.search import candidates


def table(spark, n, classes, noise, seed, width=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    y = np.digitize(x[:, 0] + 0.7 * x[:, 1] * x[:, 2] + noise * rng.normal(size=n), np.linspace(-1.2, 1.2, classes - 1))
    return spark.createDataFrame([(i, Vectors.dense(v), float(c)) for i, (v, c) in enumerate(zip(x.tolist(), y))],
                                 ["row_id", "features", "label"]).repartition(4)


def log_loss(model, df):
    p = F.element_at(vector_to_array("probability"), (F.col("label") + 1).cast("int"))
    return model.transform(df).agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12))))).first()[0]


def test_flat_trees_from_descriptions():
    t = flatten("""DecisionTreeRegressionModel: uid=x, depth=2, numNodes=5
  If (feature 1 <= 4.5E-4)
   Predict: -0.5
  Else (feature 1 > 4.5E-4)
   If (feature 0 <= -2.0)
    Predict: 1.0
   Else (feature 0 > -2.0)
    Predict: 2.0
""", [3, 7])
    assert t.feature.tolist() == [7, -1, 3, -1, -1] and t.threshold[2] == -2.0
    assert t.nodes(np.array([[9.0, 0.0], [-2.0, 1.0], [0.0, 1.0]]), {3: 0, 7: 1}).tolist() == [1, 3, 4]


def test_columns_drawn_by_hash():
    got = [drawn_columns(50, 0.8, 1, t) for t in range(3)]
    assert all(len(g) == 40 and g == sorted(set(g)) for g in got) and got[0] != got[1]
    assert drawn_columns(50, 1.0, 1, 0) == list(range(50)) and len(drawn_columns(3, 0.01, 1)) == 1


def test_boosting_lowers_the_loss_each_round_and_survives_saving(spark, tmp_path):
    train, test = table(spark, 400, 5, 0.3, 1), table(spark, 300, 5, 0.3, 2)
    model = SoftmaxBoosting(6, 0.3, 3, subsample=1.0, colsample_bytree=0.8).fit(train)
    losses = [h[0] for h in model.getOrDefault(model.history)]
    assert model.rounds == 6 and all(b < a for a, b in zip(losses, losses[1:]))
    assert log_loss(model, train) == pytest.approx(losses[-1], abs=1e-9)
    assert log_loss(model, test) < math.log(5) * 0.85
    model.write().save(f"{tmp_path}/m")
    again = SoftmaxBoostingModel.load(f"{tmp_path}/m")
    a, b = ([tuple(r.probability) for r in m.transform(test).orderBy("row_id").collect()] for m in (model, again))
    assert a == b and all(abs(sum(p) - 1) < 1e-9 for p in a)


def test_joint_boosting_beats_one_against_rest(spark):
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from tallyloom.operators.fitting import softmax

    train, test = table(spark, 400, 5, 0.3, 1), table(spark, 300, 5, 0.3, 2)
    joint = SoftmaxBoosting(8, 0.3, 3).fit(train)
    alone = OneVsRest(classifier=GBTClassifier(maxIter=8, stepSize=0.3, maxDepth=3), parallelism=5).fit(train).transform(test)
    p = F.element_at(softmax(vector_to_array("rawPrediction")), (F.col("label") + 1).cast("int"))
    assert log_loss(joint, test) < alone.agg(F.avg(-F.log(p))).first()[0]


def test_boosting_stops_early_on_noise(spark):
    rng = np.random.default_rng(5)
    rows = [(Vectors.dense(v), float(c)) for v, c in zip(rng.normal(size=(200, 3)).tolist(), rng.integers(0, 3, 200))]
    noise = spark.createDataFrame(rows, ["features", "label"])
    made = SoftmaxBoosting(30, 0.5, 3, validation_fraction=0.2, n_iter_no_change=2)
    model = made.fit(noise)
    assert 2 <= model.rounds < 30
    held = made.held_out(noise.selectExpr("features as x", "cast(label as int) y", "monotonically_increasing_id() id"))
    counts = {r.y: (r.n, r.h) for r in held.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if("held").alias("h")).collect()}
    assert all(h == math.ceil(n * 0.2) for n, h in counts.values())
    assert made._enough([9.0, 5.0, 6.0, 6.0]) and not made._enough([9.0, 5.0, 6.0, 4.0]) and not made._enough([9.0, 9.0])


def test_odd_rows_of_ensembles(spark):
    rows = [(Vectors.sparse(1000, [i % 3, 999], [1.0, 1.0]), float(i % 3)) for i in range(30)] + [(Vectors.dense([0.0] * 1000), None)]
    df = spark.createDataFrame(rows, ["features", "label"]).withColumn("_s", F.lit("x")).withColumn("id", F.lit(1))
    for model in (SoftmaxBoosting(2, 0.5, 2).fit(df), BootstrapForest(3, 3, max_features="all").fit(df)):
        done = model.transform(df.drop("_s"))
        assert done.where("label is not null and prediction <> label").count() == 0 and done.count() == 31


def test_parameters_change_the_candidates():
    space = {"n_estimators": [10], "n_iter_no_change": [None, 3], "tol": [1e-4, 1e-2], "validation_fraction": [0.1, 0.2]}
    assert len(candidates("Gradient Boosting", space=space)) == 8
    assert len(candidates("Random Forest", space={"class_weight": ["balanced", "balanced_subsample"]})) == 2
    assert len(candidates("MLP", space={"solver": ["adam"], "learning_rate_init": [0.1, 0.01]})) == 2
    assert len(candidates("MLP", space={"solver": ["lbfgs"], "learning_rate_init": [0.1, 0.01]})) == 1


def test_bootstrap_weights_differ_by_tree(spark, tmp_path):
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.1).astype(float)
    rows = [(i, Vectors.dense([c + rng.normal(), rng.normal()]), float(c)) for i, c in enumerate(y)]
    df = spark.createDataFrame(rows, ["row_id", "features", "label"]).repartition(4)
    forest = BootstrapForest(5, 4)
    keyed = df.selectExpr("row_id as id", "cast(label as int) y")
    draws = keyed.agg(*[F.sum(forest.drawn(t)).alias(f"n{t}") for t in range(5)]).first()
    assert all(320 < n < 480 for n in draws) and len(set(draws)) > 1
    weights = forest.class_weights(keyed, range(5))
    assert len({tuple(sorted(w.items())) for w in weights.values()}) == 5
    assert all(w[1] > 4 * w[0] for w in weights.values())
    model = forest.fit(df)
    done = model.transform(df)
    recall = done.where("label = 1").agg(F.avg(F.expr("cast(prediction = 1 as double)"))).first()[0]
    assert recall > 0.5 and len(model.trees) == 5
    model.write().save(f"{tmp_path}/f")
    again = BootstrapForestModel.load(f"{tmp_path}/f").transform(df)
    assert [r.prediction for r in again.orderBy("row_id").collect()] == [r.prediction for r in done.orderBy("row_id").collect()]
    named = Classifier("Random Forest", {"class_weight": "balanced_subsample", "n_estimators": 2}).fit(df)
    assert isinstance(named, BootstrapForestModel)


def calibration_error(done, column, classes, bins=8):
    """Mean gap between a class's probability and its share, over bins of probability."""
    rows = done.select("label", vector_to_array(column).alias("p")).collect()
    gap = 0.0
    for c in range(classes):
        p, hit = np.array([r.p[c] for r in rows]), np.array([r.label == c for r in rows], float)
        at = np.minimum((p * bins).astype(int), bins - 1)
        gap += sum(abs(p[at == b].mean() - hit[at == b].mean()) * (at == b).mean() for b in range(bins) if (at == b).any())
    return gap / classes


def test_sigmoids_are_the_likeliest(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(500, 2)) * 2
    y = (rng.random(500) < 1 / (1 + np.exp(-(1.5 * m[:, 1] - 0.5)))).astype(int)
    df = spark.createDataFrame([(int(c), v) for c, v in zip(y, m.tolist())], "y int, m array<double>")
    slopes, shifts = calibration.fit_sigmoids(df, 2)
    high, low = calibration.smoothed_targets(int(y.sum()), 500)
    t = np.where(y == 1, high, low)
    p = 1 / (1 + np.exp(-(slopes[1] * m[:, 1] + shifts[1])))
    assert abs((p - t).sum()) < 1e-5 and abs(((p - t) * m[:, 1]).sum()) < 1e-5
    assert 1.0 < slopes[1] < 2.2


def test_calibration_lowers_the_calibration_error(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import array_to_vector
    from tallyloom.operators.fitting import softmax

    train, test = table(spark, 500, 3, 1.0, 11, 3), table(spark, 500, 3, 1.0, 12, 3)
    model = Classifier("SVM", {"C": 1.0, "max_iter": 30}).fit(train)
    done = model.transform(test).withColumn("plain", array_to_vector(softmax(vector_to_array("rawPrediction"))))
    assert calibration_error(done, "probability", 3) < calibration_error(done, "plain", 3)
    assert done.select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, v: a + v).alias("t")).where(
        "abs(t - 1) > 1e-9").count() == 0
    model.write().save(f"{tmp_path}/s")
    again = PipelineModel.load(f"{tmp_path}/s").transform(test)
    assert [r.probability for r in again.orderBy("row_id").collect()] == [r.probability for r in done.orderBy("row_id").collect()]


def test_perceptron_takes_solver_and_step(spark):
    df = table(spark, 200, 2, 0.1, 1, 3)
    for params in ({"solver": "adam", "learning_rate_init": 0.5}, {"solver": "lbfgs"}):
        model = Classifier("MLP", {"hidden_layer_sizes": (4,), "max_iter": 20, **params}).fit(df)
        assert model.getOrDefault("solver") == ("gd" if params["solver"] == "adam" else "l-bfgs")
        assert params["solver"] == "lbfgs" or model.getOrDefault("stepSize") == 0.5
