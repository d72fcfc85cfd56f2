"""Classifiers on Spark ML, under the registry names and parameter names users already know.

``Classifier(name, params)`` is an ``Estimator``: at fit time it reads the row count, the feature
width and the class sizes where the model needs them, maps the parameters onto the Spark ML estimator and fits it.
Every fitted model adds ``prediction`` and ``probability``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml import classification as mlc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scale import bounded_rows, materialise, new_path
from tallyloom.operators.boosting import BootstrapForest, SoftmaxBoosting
from tallyloom.operators.calibration import CalibratedSVM
from tallyloom.operators.fitting import Columns as _Columns
from tallyloom.operators.fitting import argmax_label, softmax
from tallyloom.operators.neighbors import cross_neighbors, vote
from tallyloom.operators.prep import MAX_CATEGORIES, class_sizes, with_class_weights

# Search spaces of the registry, by model.
SPACES: dict[str, dict | list] = {
    "Logistic Regression": {
        "penalty": ["l2"], "solver": ["lbfgs", "newton-cg", "sag"], "C": [0.1, 1.0, 10.0],
        "max_iter": [3000, 5000, 7000], "class_weight": ["balanced", None]},
    "Decision Tree": {
        "criterion": ["gini", "entropy"], "max_depth": [None, 10, 20, 30],
        "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
        "max_features": ["sqrt", "log2"]},
    "Random Forest": {
        "n_estimators": [100, 200, 300], "max_depth": [None, 10, 20, 30],
        "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
        "max_features": ["sqrt", "log2"], "class_weight": ["balanced", "balanced_subsample"]},
    "Gradient Boosting": {
        "n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.1, 0.3],
        "max_depth": [3, 5, 7], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
    "SVM": [{"C": [0.1, 1.0, 10.0], "kernel": ["linear"], "class_weight": ["balanced"]}],
    "KNN": {"n_neighbors": [3, 5, 7, 9], "weights": ["uniform", "distance"],
            "metric": ["euclidean", "manhattan"]},
    "XGBoost": {
        "n_estimators": [100, 200, 300], "max_depth": [3, 6, 9], "learning_rate": [0.01, 0.1, 0.3],
        "subsample": [0.8, 0.9, 1.0], "colsample_bytree": [0.8, 0.9, 1.0]},
    "Naive Bayes": {"var_smoothing": [1e-5, 1e-4, 1e-3]},
    "MLP": [
        {"hidden_layer_sizes": [(100,), (50, 25), (100, 50)], "activation": ["relu", "tanh"],
         "alpha": [0.0001, 0.001, 0.01], "batch_size": [32, 64, 128],
         "learning_rate": ["constant", "adaptive"], "max_iter": [1000, 2000],
         "solver": ["adam"], "learning_rate_init": [0.001, 0.01]},
        {"hidden_layer_sizes": [(100,), (50, 25), (100, 50)], "activation": ["relu", "tanh"],
         "alpha": [0.0001, 0.001, 0.01], "batch_size": [32, 64, 128],
         "learning_rate": ["constant", "adaptive"], "max_iter": [1000, 2000],
         "solver": ["lbfgs"]}],
}

# The spaces the behaviour program uses instead.
BEHAVIOR_SPACES: dict[str, dict | list] = {
    "Logistic Regression": {
        "penalty": ["l2"], "C": [0.01, 0.1, 1.0, 10.0], "solver": ["lbfgs", "newton-cg"],
        "max_iter": [5000], "class_weight": ["balanced"]},
    "Random Forest": {
        "n_estimators": [100, 200, 300], "max_depth": [10, 20, 30, None],
        "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
        "max_features": ["sqrt", "log2"], "class_weight": ["balanced", "balanced_subsample"],
        "bootstrap": [True], "criterion": ["gini", "entropy"]},
    "SVM": [{"C": [0.1, 1.0, 10.0], "kernel": ["linear"], "class_weight": ["balanced"]}],
    "MLP": [{
        "hidden_layer_sizes": [(50,), (100,), (50, 25), (100, 50)], "activation": ["relu", "tanh"],
        "alpha": [0.0001, 0.001, 0.01], "batch_size": [32, 64], "learning_rate": ["adaptive"],
        "max_iter": [2000], "early_stopping": [True], "validation_fraction": [0.1],
        "n_iter_no_change": [10], "solver": ["adam"], "learning_rate_init": [0.001, 0.01]}],
    "XGBoost": {
        "n_estimators": [100, 200, 300], "max_depth": [3, 6, 9], "learning_rate": [0.01, 0.1, 0.3],
        "subsample": [0.8, 0.9, 1.0], "colsample_bytree": [0.8, 0.9, 1.0]},
    "Gradient Boosting": {
        "n_estimators": [300], "learning_rate": [0.01, 0.05, 0.1], "max_depth": [3, 5, 7],
        "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4], "subsample": [0.8, 0.9, 1.0],
        "validation_fraction": [0.1], "n_iter_no_change": [10], "tol": [1e-4]},
}

# Parameters of the spaces that have no counterpart here and change nothing.
WITHOUT_EFFECT: dict[str, set[str]] = {
    "Logistic Regression": {"penalty", "solver"},
    "Decision Tree": {"min_samples_split"},
    "Random Forest": {"min_samples_split"},
    "Gradient Boosting": {"min_samples_split"},
    "MLP": {"activation", "alpha", "learning_rate", "early_stopping", "validation_fraction", "n_iter_no_change"},
}


def effective(model: str, params: dict) -> dict:
    """The parameters that change the fitted model. A step size matters to gradient descent alone."""
    out = {k: v for k, v in params.items() if k not in WITHOUT_EFFECT.get(model, ())}
    if model == "MLP" and out.get("solver", "lbfgs") == "lbfgs":
        out.pop("learning_rate_init", None)
    return out


MAX_DEPTH = 30   # Spark's deepest tree; stands for an unlimited one


def param_space(model: str, program: str = "base") -> dict | list:
    base = SPACES[model]
    return BEHAVIOR_SPACES.get(model, base) if program == "behavior" else base


# ---------------------------------------------------------------- Gaussian naive Bayes

class GaussianNB(Estimator, _Columns):
    """Gaussian naive Bayes: class means and variances in one grouped pass; ``var_smoothing`` times
    the largest overall variance is added to every variance."""

    def __init__(self, var_smoothing: float = 1e-9, featuresCol: str = "features",
                 labelCol: str = "label"):
        super().__init__()
        self.var_smoothing = var_smoothing
        self._columns(featuresCol, labelCol)

    def _fit(self, df: DataFrame) -> "GaussianNBModel":
        summary = Summarizer.metrics("count", "mean", "variance").summary(F.col(self.features))
        rows = bounded_rows(
            df.where(F.col(self.label).isNotNull()).groupBy(F.col(self.label).cast("int").alias("c"))
              .agg(summary.alias("s")).select("c", "s.count", "s.mean", "s.variance"),
            MAX_CATEGORIES, "classes")
        rows = sorted(rows, key=lambda r: r["c"])
        n = np.array([r[1] for r in rows], dtype="float64")
        mean = np.array([r["mean"].toArray() for r in rows])
        var = np.array([r["variance"].toArray() for r in rows]) * ((n - 1) / n)[:, None]
        grand = (n[:, None] * mean).sum(axis=0) / n.sum()
        overall = (n[:, None] * (var + (mean - grand) ** 2)).sum(axis=0) / n.sum()
        var = var + self.var_smoothing * overall.max()
        return GaussianNBModel(labels=[int(r["c"]) for r in rows], priors=(n / n.sum()).tolist(),
                               means=mean.tolist(), variances=var.tolist(),
                               featuresCol=self.features)


class GaussianNBModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    labels = Param(Params._dummy(), "labels", "class codes", TypeConverters.toListInt)
    priors = Param(Params._dummy(), "priors", "class shares", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "class means", TypeConverters.identity)
    variances = Param(Params._dummy(), "variances", "smoothed variances", TypeConverters.identity)

    def __init__(self, labels=None, priors=None, means=None, variances=None,
                 featuresCol: str = "features"):
        super().__init__()
        self._columns(featuresCol, "label")
        if labels is not None:
            self._set(labels=labels, priors=priors, means=means, variances=variances)

    def _transform(self, df: DataFrame) -> DataFrame:
        got = self.getOrDefault
        labels = np.array(got(self.labels))
        mean, inverse = np.array(got(self.means)), 1.0 / np.array(got(self.variances))
        const = np.log(got(self.priors)) - 0.5 * np.log(2 * math.pi / inverse).sum(axis=1)

        @F.arrow_udf("array<double>")
        def log_scores(vectors: pa.Array) -> pa.Array:
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), mean.shape[1])
            out = np.full((len(x), labels.max() + 1), -np.inf)
            for c, m, inv, k in zip(labels, mean, inverse, const):
                out[:, c] = k - 0.5 * (((x - m) ** 2) * inv).sum(axis=1)
            ends = np.arange(len(x) + 1, dtype="int32") * out.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.ravel()))

        return (df.withColumn("_s", log_scores(vector_to_array(F.col(self.features))))
                  .withColumn("prediction", argmax_label(F.col("_s")))
                  .withColumn("probability", array_to_vector(softmax(F.col("_s"))))
                  .drop("_s"))


# ---------------------------------------------------------------- k nearest neighbours

def _digest(vec: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.transform(vec, lambda x: x.cast("string"))), 256)


class KNNClassifier(Estimator, _Columns):
    """k nearest neighbours by the partitioned neighbour join; fitting stores the training rows."""

    def __init__(self, n_neighbors: int = 5, weights: str = "uniform", metric: str = "euclidean",
                 featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self.options = (n_neighbors, weights, metric)
        self._columns(featuresCol, labelCol)

    def _fit(self, df: DataFrame) -> "KNNModel":
        spark = df.sparkSession
        path = new_path(spark, "knn")
        (df.where(F.col(self.label).isNotNull())
           .select(F.concat_ws("-", _digest(vector_to_array(self.features)),      # ties: by vector, then label
                               F.col(self.label).cast("string")).alias("_k"),
                   vector_to_array(self.features).alias("vec"),
                   F.col(self.label).cast("double").alias("label")).write.parquet(path))
        k, weights, metric = self.options
        return KNNModel(path, k, weights, metric, self.features)


class _RowsWriter(DefaultParamsWriter):
    """Parameters plus a copy of the training rows inside the model's folder."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        source = self.instance.getOrDefault(self.instance.path)
        self.sparkSession.read.parquet(source).write.parquet(f"{path}/rows")


class _RowsReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        return model._set(path=f"{path}/rows")


class KNNModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    path = Param(Params._dummy(), "path", "stored training rows", TypeConverters.toString)
    nNeighbors = Param(Params._dummy(), "nNeighbors", "k", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    metric = Param(Params._dummy(), "metric", "euclidean or manhattan", TypeConverters.toString)

    def __init__(self, path: str = "", k: int = 5, weights: str = "uniform",
                 metric: str = "euclidean", featuresCol: str = "features"):
        super().__init__()
        self._columns(featuresCol, "label")
        self._set(path=path, nNeighbors=k, weights=weights, metric=metric)

    def write(self) -> DefaultParamsWriter:
        return _RowsWriter(self)

    @classmethod
    def read(cls) -> DefaultParamsReader:
        return _RowsReader(cls)

    def _transform(self, df: DataFrame) -> DataFrame:
        got = self.getOrDefault
        donors = df.sparkSession.read.parquet(got(self.path))
        classes = int(donors.agg(F.max("label")).first()[0]) + 1
        # equal feature vectors get equal answers, so each is asked once
        vec = vector_to_array(F.col(self.features))
        asked = materialise(df.select(vec.alias("vec")).distinct()
                              .withColumn("_k", _digest(F.col("vec"))), "asked")
        near = cross_neighbors(asked, donors, "_k", "vec", "label", got(self.nNeighbors),
                               got(self.metric))
        votes = vote(near, got(self.weights))
        total = F.sum("weight")
        share = F.map_from_entries(F.collect_list(F.struct(       # at most k classes per query
            F.col("payload").cast("int").alias("c"), F.col("weight").alias("w"))))
        answer = votes.groupBy("q_key").agg(share.alias("_w"), total.alias("_t")).select(
            "q_key", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)),
                                 lambda c: F.coalesce(F.try_element_at("_w", c), F.lit(0.0))
                                 / F.col("_t")).alias("_p"))
        answered = asked.join(answer, asked["_k"] == answer["q_key"]).select(
            F.col("vec").alias("_vec"), "_p")
        out = df.withColumn("_v", vec)
        out = out.join(answered, out["_v"] == answered["_vec"], "left")
        return (out.withColumn("prediction", argmax_label(F.col("_p")))
                   .withColumn("probability", array_to_vector(F.col("_p")))
                   .drop("_v", "_vec", "_p"))


# ---------------------------------------------------------------- registry

def _depth(value) -> int:
    return MAX_DEPTH if value is None else min(int(value), MAX_DEPTH)


def _tree(p: dict, cols: dict, seed: int, trees: int, bootstrap: bool):
    return mlc.RandomForestClassifier(
        numTrees=trees, maxDepth=_depth(p.get("max_depth")), impurity=p.get("criterion", "gini"),
        minInstancesPerNode=int(p.get("min_samples_leaf", 1)), bootstrap=bootstrap,
        featureSubsetStrategy=p.get("max_features") or "all", seed=seed, **cols)


def _logistic(p, cols, seed, n, width, k):
    return mlc.LogisticRegression(family="multinomial", maxIter=int(p.get("max_iter", 5000)),
                                  regParam=1.0 / (float(p.get("C", 1.0)) * n), **cols)


def _decision_tree(p, cols, seed, n, width, k):
    return _tree(p, cols, seed, 1, False)


def _forest(p, cols, seed, n, width, k):
    p = {"max_features": "sqrt", **p}
    if p.get("class_weight") == "balanced_subsample" and p.get("bootstrap", True):
        return BootstrapForest(int(p.get("n_estimators", 100)), _depth(p.get("max_depth")), int(p.get("min_samples_leaf", 1)),
                               p.get("criterion", "gini"), p["max_features"] or "all", seed=seed, **_plain(cols))
    return _tree(p, cols, seed, int(p.get("n_estimators", 100)), bool(p.get("bootstrap", True)))


def _boosting(p, cols, seed, n, width, k):
    return SoftmaxBoosting(
        int(p.get("n_estimators", 100)), float(p.get("learning_rate", 0.1)), _depth(p.get("max_depth", 3)),
        int(p.get("min_samples_leaf", 1)), float(p.get("subsample", 1.0)),
        validation_fraction=float(p.get("validation_fraction", 0.1)), n_iter_no_change=p.get("n_iter_no_change"),
        tol=float(p.get("tol", 1e-4)), seed=seed, **_plain(cols))


def _regularised_boosting(p, cols, seed, n, width, k):
    return SoftmaxBoosting(
        int(p.get("n_estimators", 100)), float(p.get("learning_rate", 0.3)), _depth(p.get("max_depth", 6)), 1,
        float(p.get("subsample", 1.0)), float(p.get("colsample_bytree", 1.0)), ridge=float(p.get("reg_lambda", 1.0)),
        shrink_classes=False, n_iter_no_change=p.get("early_stopping_rounds"), seed=seed, **_plain(cols))


def _svm(p, cols, seed, n, width, k):
    if p.get("kernel", "linear") != "linear":
        raise ValueError("only the linear kernel is available")
    return CalibratedSVM(1.0 / (float(p.get("C", 1.0)) * n), int(p.get("max_iter", 100)), seed=seed, **cols)


def _perceptron(p, cols, seed, n, width, k):
    """'lbfgs' as it is; 'adam' and 'sgd' become plain gradient descent with ``learning_rate_init`` as step."""
    hidden = [int(h) for h in p.get("hidden_layer_sizes", (100,))]
    descent = p.get("solver", "lbfgs") != "lbfgs"
    step = {"stepSize": float(p.get("learning_rate_init", 0.001))} if descent else {}
    return mlc.MultilayerPerceptronClassifier(
        layers=[width, *hidden, k], maxIter=int(p.get("max_iter", 1000)), seed=seed,
        solver="gd" if descent else "l-bfgs", blockSize=int(p.get("batch_size", 128)), **step, **_plain(cols))


def _plain(cols: dict) -> dict:
    return {c: v for c, v in cols.items() if c != "weightCol"}


def _naive_bayes(p, cols, seed, n, width, k):
    return GaussianNB(float(p.get("var_smoothing", 1e-9)), **_plain(cols))


def _knn(p, cols, seed, n, width, k):
    return KNNClassifier(int(p.get("n_neighbors", 5)), p.get("weights", "uniform"),
                         p.get("metric", "euclidean"), **_plain(cols))


BUILDERS: dict[str, Callable] = {
    "Logistic Regression": _logistic, "Decision Tree": _decision_tree, "Random Forest": _forest,
    "Gradient Boosting": _boosting, "SVM": _svm, "KNN": _knn, "XGBoost": _regularised_boosting,
    "Naive Bayes": _naive_bayes, "MLP": _perceptron,
}


# Builders that use neither row count, width nor classes, and whose fits check the labels themselves.
WITHOUT_FACTS = {"Naive Bayes", "Decision Tree"}


class Classifier(Estimator, _Columns):
    """A registry model with its parameters, to be fitted alone or as a pipeline stage."""

    def __init__(self, name: str, params: dict | None = None, featuresCol: str = "features",
                 labelCol: str = "label", seed: int = 42):
        super().__init__()
        if name not in BUILDERS:
            raise ValueError(f"unknown model {name!r}; one of {sorted(BUILDERS)}")
        self.name, self.settings, self.seed = name, dict(params or {}), seed
        self._columns(featuresCol, labelCol)

    def _fit(self, df: DataFrame) -> Model:
        cols = {"featuresCol": self.features, "labelCol": self.label}
        if self.settings.get("class_weight") == "balanced" or (
                self.settings.get("class_weight") == "balanced_subsample" and not self.settings.get("bootstrap", True)):
            df = with_class_weights(df, self.label, "_weight")
            cols["weightCol"] = "_weight"
        if self.name in WITHOUT_FACTS:
            return BUILDERS[self.name](self.settings, cols, self.seed, 0, 0, 0).fit(df)
        sizes = class_sizes(df, self.label)
        width = df.select(F.size(vector_to_array(self.features))).first()[0]
        real = BUILDERS[self.name](self.settings, cols, self.seed, sum(sizes.values()), width,
                                   int(max(sizes)) + 1)
        return real.fit(df)


def naive_bayes_table(df: DataFrame, features: str, label: str, smoothing: float) -> DataFrame:
    """(class, feature, prior, mean, variance) of a fitted Gaussian model."""
    model = GaussianNB(smoothing, features, label).fit(df)
    got = model.getOrDefault
    rows = [(c, j, float(p), float(m), float(v))
            for c, p, ms, vs in zip(got(model.labels), got(model.priors), got(model.means),
                                    got(model.variances))
            for j, (m, v) in enumerate(zip(ms, vs))]
    return df.sparkSession.createDataFrame(
        rows, "class int, feature int, prior double, mean double, variance double")
