"""Tree ensembles that Spark ML lacks, grown from its single trees.

``SoftmaxBoosting``: one additive model for all classes. Every round fits, for each class, a regression tree to the
residual between the class indicator and its softmax probability, then replaces the leaf values by Newton
steps from sums counted per leaf. Rows are drawn per round and columns per tree, by hash. With
``n_iter_no_change`` a hash-dealt, class-stratified part of the rows decides when to stop.

``BootstrapForest``: one-tree forests on hash-drawn Poisson row weights, each with the class weights of its own
bootstrap sample, merged into one vote by leaf class shares.

Rows are stored once under a row number; a boosting round stores their new margins and forgets the table
of the round before, so two copies exist at most. The trees of a round are fitted side by side. The driver
holds tree nodes and sums per leaf only.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scale import forget, hash_rank, materialise, new_path
from tallyloom.operators.fitting import (
    Columns, FlatTree, argmax_label, draw, drawn_columns, flatten, load_trees, save_trees, softmax, tree_sums, used_features,
    used_values,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARALLEL_TREES = 8
LEAST_HESSIAN = 1e-12
# P(at most j) of a Poisson draw with mean 1, up to where doubles end
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(j + 1)) for j in range(15)]


def _rows(df: DataFrame, features: str, label: str) -> DataFrame:
    """Stored (x, y, id) of the labelled rows."""
    plain = df.where(F.col(label).isNotNull()).select(F.col(features).alias("x"), F.col(label).cast("int").alias("y"))
    return materialise(plain.withMetadata("x", {}).withColumn("id", F.monotonically_increasing_id()), "tree-rows")


def _side_by_side(spark: SparkSession, fit: Callable, jobs: Sequence) -> list:
    with ThreadPoolExecutor(max_workers=PARALLEL_TREES) as pool:
        return [r.result() for r in [pool.submit(inheritable_thread_target(spark)(fit), job) for job in jobs]]


def leaf_sums(df: DataFrame, trees: Sequence[FlatTree], used: list[int], channels: int) -> dict[tuple[int, int], np.ndarray]:
    """(tree, leaf) -> sums of its rows' channels. ``df`` has v (used features) and c, ``channels`` numbers per tree.

    Tasks add up their own rows first; at most trees x leaves rows come back.
    """
    place = {f: i for i, f in enumerate(used)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(t.feature), channels)) for t in trees]
        for b in batches:
            x = np.asarray(b.column("v").flatten()).reshape(b.num_rows, len(used))
            c = np.asarray(b.column("c").flatten()).reshape(b.num_rows, len(trees), channels)
            for i, t in enumerate(trees):
                np.add.at(total[i], t.nodes(x, place), c[:, i])
        found = [(i, int(n), total[i][n].tolist()) for i in range(len(trees)) for n in np.flatnonzero(total[i].any(axis=1))]
        tree, node, sums = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(node, pa.int32()),
                                          pa.array(sums, pa.list_(pa.float64()))], ["tree", "node", "sums"])

    parts = df.select("v", "c").mapInArrow(run, "tree int, node int, sums array<double>")
    whole = parts.groupBy("tree", "node").agg(*[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(channels)])
    return {(r["tree"], r["node"]): np.array([r[f"s{j}"] for j in range(channels)]) for r in whole.collect()}


# ---------------------------------------------------------------- boosting

class SoftmaxBoosting(Estimator, Columns):
    """``shrink_classes`` scales leaves by (classes - 1) / classes; ``ridge`` is added to every leaf's curvature."""

    def __init__(self, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3, min_samples_leaf: int = 1,
                 subsample: float = 1.0, colsample_bytree: float = 1.0, ridge: float = 0.0, shrink_classes: bool = True,
                 validation_fraction: float = 0.1, n_iter_no_change: int | None = None, tol: float = 1e-4,
                 featuresCol: str = "features", labelCol: str = "label", seed: int = 42):
        super().__init__()
        self.n_estimators, self.learning_rate, self.max_depth = n_estimators, learning_rate, max_depth
        self.min_samples_leaf, self.subsample, self.colsample = min_samples_leaf, subsample, colsample_bytree
        self.ridge, self.shrink_classes, self.seed = ridge, shrink_classes, seed
        self.validation_fraction, self.n_iter_no_change, self.tol = validation_fraction, n_iter_no_change, tol
        self._columns(featuresCol, labelCol)

    def held_out(self, rows: DataFrame) -> DataFrame:
        """Adds ``held``: the rows whose loss decides when to stop, a share of each class in hash order."""
        if not self.n_iter_no_change:
            return rows.withColumn("held", F.lit(False))
        ranked = hash_rank(rows, "id", f"{self.seed}-held", ["y"])
        least = F.least(F.ceil(F.col("_size") * F.lit(self.validation_fraction)), F.col("_size") - 1)
        return ranked.withColumn("held", F.col("_rank") <= least).drop("_rank", "_size")

    def _tree(self, state: DataFrame, k: int, number: int, width: int) -> FlatTree:
        columns = drawn_columns(width, self.colsample, self.seed, number, k)
        rows = state.where(~F.col("held") & (draw("id", self.seed, number) < self.subsample)).select(
            "x", ((F.col("y") == k).cast("double") - F.col("p")[k]).alias("residual"))
        if len(columns) < width:
            rows = VectorSlicer(inputCol="x", outputCol="part", indices=columns).transform(rows)
        fitted = DecisionTreeRegressor(featuresCol="part" if len(columns) < width else "x", labelCol="residual",
                                       maxDepth=self.max_depth, minInstancesPerNode=self.min_samples_leaf,
                                       seed=self.seed).fit(rows.withMetadata("x", {}))
        return flatten(fitted.toDebugString, columns)

    def _newton(self, state: DataFrame, trees: list[FlatTree], used: list[int], number: int) -> None:
        """Leaf values: sum of residuals over sum of curvatures of the round's rows."""
        k = len(trees)
        rows = used_values(state.where(~F.col("held") & (draw("id", self.seed, number) < self.subsample)), "x", used, "v")
        channels = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.array(
            (F.col("y") == c).cast("double") - F.get(F.col("p"), c), F.get(F.col("p"), c) * (1 - F.get(F.col("p"), c)))))
        sums = leaf_sums(rows.withColumn("c", channels), trees, used, 2)
        scale = self.learning_rate * ((k - 1) / k if self.shrink_classes else 1.0)
        for i, t in enumerate(trees):
            t.value[:] = 0.0
            for n in np.flatnonzero(t.feature < 0):
                r, h = sums.get((i, int(n)), (0.0, 0.0))
                t.value[n] = scale * r / (h + self.ridge) if h + self.ridge > LEAST_HESSIAN else 0.0

    def _fit(self, df: DataFrame) -> "SoftmaxBoostingModel":
        spark = df.sparkSession
        rows = self.held_out(_rows(df, self.features, self.label))
        counts = {r["y"]: r["n"] for r in rows.where(~F.col("held")).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        classes, n = max(counts) + 1, sum(counts.values())
        start = [math.log(max(counts.get(c, 0), 0.5) / n) for c in range(classes)]
        width = rows.select(F.size(_array("x"))).first()[0]
        margins, path = F.array(*[F.lit(v) for v in start]), ""
        trees, history, state = [], [], rows.withColumn("f", margins)
        for number in range(self.n_estimators + 1):
            old, path = path, new_path(spark, "margins")
            state.withColumn("p", softmax(F.col("f"))).write.parquet(path)
            state = spark.read.parquet(path)
            if old:
                forget(spark, old)
            loss = -F.log(F.greatest(F.get(F.col("p"), F.col("y")), F.lit(1e-300)))
            both = state.agg(F.avg(F.when(~F.col("held"), loss)), F.avg(F.when(F.col("held"), loss))).first()
            history.append([float(both[0]), float(both[1]) if both[1] is not None else float("nan")])
            if number == self.n_estimators or self._enough([h[1] for h in history]):
                break
            grown = _side_by_side(spark, lambda k: self._tree(state, k, number, width), range(classes))  # noqa: B023
            used = used_features(grown)
            self._newton(state, grown, used, number)
            add = tree_sums(grown, used, classes, range(classes))
            state = used_values(state, "x", used, "v").withColumn(
                "f", F.zip_with("f", add("v"), lambda a, b: a + b)).drop("v", "p")
            trees += grown
        forget(spark, path)
        return SoftmaxBoostingModel(trees, start, history, self.features)

    def _enough(self, losses: list[float]) -> bool:
        """No loss of the last ``n_iter_no_change`` rounds is lower than all before them by ``tol``."""
        n = self.n_iter_no_change
        return bool(n) and len(losses) > n + 1 and min(losses[-n:]) > min(losses[:-n]) - self.tol


def _array(vector: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(vector)


class _TreesWriter(DefaultParamsWriter):
    """Parameters plus the table of tree nodes."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        save_trees(self.instance.trees, f"{path}/trees", self.sparkSession)


class _TreesReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        model.trees = load_trees(f"{path}/trees", self.sparkSession)
        return model


class _TreesModel(Model, Columns, DefaultParamsReadable, DefaultParamsWritable):
    trees: list[FlatTree] = []

    def write(self) -> DefaultParamsWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> DefaultParamsReader:
        return _TreesReader(cls)

    def _sums(self, df: DataFrame, outputs: int, group: Sequence[int]) -> DataFrame:
        used = used_features(self.trees)
        return used_values(df, self.features, used, "_v").withColumn(
            "_s", tree_sums(self.trees, used, outputs, group)(F.col("_v"))).drop("_v")


class SoftmaxBoostingModel(_TreesModel):
    start = Param(Params._dummy(), "start", "log shares of the classes", TypeConverters.toListFloat)
    history = Param(Params._dummy(), "history", "training and held-out log loss before each round", TypeConverters.identity)

    def __init__(self, trees=None, start=None, history=None, featuresCol: str = "features"):
        super().__init__()
        self._columns(featuresCol, "label")
        self.trees = trees or []
        if start is not None:
            self._set(start=start, history=history)

    @property
    def rounds(self) -> int:
        return len(self.trees) // len(self.getOrDefault(self.start))

    def _transform(self, df: DataFrame) -> DataFrame:
        start = self.getOrDefault(self.start)
        k = len(start)
        summed = self._sums(df, k, [i % k for i in range(len(self.trees))])
        margins = F.zip_with(F.array(*[F.lit(v) for v in start]), "_s", lambda a, b: a + b)
        return (summed.withColumn("_s", margins).withColumn("prediction", argmax_label(F.col("_s")))
                      .withColumn("probability", array_to_vector(softmax(F.col("_s")))).drop("_s"))


# ---------------------------------------------------------------- bootstrap forest

class BootstrapForest(Estimator, Columns):
    """A forest whose trees weigh classes by their own bootstrap samples ('balanced_subsample')."""

    def __init__(self, n_estimators: int = 100, max_depth: int = 30, min_samples_leaf: int = 1, criterion: str = "gini",
                 max_features: str = "sqrt", featuresCol: str = "features", labelCol: str = "label", seed: int = 42):
        super().__init__()
        self.n_estimators, self.max_depth, self.min_samples_leaf = n_estimators, max_depth, min_samples_leaf
        self.criterion, self.max_features, self.seed = criterion, max_features, seed
        self._columns(featuresCol, labelCol)

    def drawn(self, t: int) -> Column:
        """How often tree ``t`` draws a row."""
        u = draw("id", self.seed, "tree", t)
        return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON[1:]), F.when(u >= POISSON[0], 1).otherwise(0))

    def class_weights(self, rows: DataFrame, trees: Sequence[int]) -> dict[int, dict[int, float]]:
        """tree -> class -> size of the tree's sample over (classes present x the class's rows in it)."""
        sums = rows.groupBy("y").agg(*[F.sum(self.drawn(t)).alias(f"n{t}") for t in trees]).collect()
        out = {}
        for t in trees:
            have = {r["y"]: r[f"n{t}"] for r in sums if r[f"n{t}"]}
            out[t] = {c: sum(have.values()) / (len(have) * n) for c, n in have.items()}
        return out

    def _fit(self, df: DataFrame) -> "BootstrapForestModel":
        spark, rows, trees = df.sparkSession, _rows(df, self.features, self.label), []
        classes = rows.agg(F.max("y")).first()[0] + 1
        for first in range(0, self.n_estimators, PARALLEL_TREES):
            batch = range(first, min(first + PARALLEL_TREES, self.n_estimators))
            weights = {t: w for t, w in self.class_weights(rows, batch).items() if w}

            def weight(t: int) -> Column:
                of = F.create_map(*[F.lit(v) for c, w in weights[t].items() for v in (c, w)])  # noqa: B023
                return self.drawn(t) * F.coalesce(F.try_element_at(of, F.col("y")), F.lit(0.0))

            def fit(t: int) -> FlatTree:
                sample = rows.withColumn("w", weight(t)).where("w > 0")  # noqa: B023
                one = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=1, bootstrap=False,
                                             maxDepth=self.max_depth, minInstancesPerNode=self.min_samples_leaf,
                                             impurity=self.criterion, featureSubsetStrategy=self.max_features,
                                             seed=self.seed + t)
                return flatten(one.fit(sample).toDebugString)

            if not weights:
                continue
            grown = _side_by_side(spark, fit, list(weights))
            used = used_features(grown)
            each = [F.array(*[F.when(F.col("y") == c, weight(t)).otherwise(F.lit(0.0)) for c in range(classes)])
                    for t in weights]
            sums = leaf_sums(used_values(rows, "x", used, "v").withColumn("c", F.concat(*each)), grown, used, classes)
            for i, t in enumerate(grown):
                value = np.full((len(t.feature), classes), 1.0 / classes)
                for n in np.flatnonzero(t.feature < 0):
                    got = sums.get((i, int(n)))
                    if got is not None and got.sum() > 0:
                        value[n] = got / got.sum()
                t.value = value
            trees += grown
        return BootstrapForestModel(trees, classes, self.features)


class BootstrapForestModel(_TreesModel):
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)

    def __init__(self, trees=None, classes: int | None = None, featuresCol: str = "features"):
        super().__init__()
        self._columns(featuresCol, "label")
        self.trees = trees or []
        if classes is not None:
            self._set(classes=classes)

    def _transform(self, df: DataFrame) -> DataFrame:
        n = self.getOrDefault(self.classes)
        shares = F.transform("_s", lambda v: v / F.lit(float(len(self.trees))))
        return (self._sums(df, n, [0] * len(self.trees)).withColumn("_s", shares)
                    .withColumn("prediction", argmax_label(F.col("_s")))
                    .withColumn("probability", array_to_vector(F.col("_s"))).drop("_s"))
