"""Linear support vectors with calibrated class probabilities.

One-against-rest margins are no probabilities. Each class gets a sigmoid of its margin, fitted on margins of rows
that the margin's model has not seen (``FOLDS`` hash-dealt, class-stratified parts), with the targets pulled
towards the middle by the class counts. The sigmoids of all classes are fitted together: every Newton step
is one aggregation over (class, margin). Probabilities are normalised over the classes; the predicted class stays the
one with the largest margin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scale import hash_rank, materialise
from tallyloom.operators.fitting import Columns

FOLDS = 3
STEPS = 40
ABSENT = -1.0     # margin of a class that a part's model has never seen


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


class SigmoidProbability(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability``: the normalised sigmoids of ``rawPrediction``."""
    slopes = Param(Params._dummy(), "slopes", "per class", TypeConverters.toListFloat)
    shifts = Param(Params._dummy(), "shifts", "per class", TypeConverters.toListFloat)

    def __init__(self, slopes: Sequence[float] | None = None, shifts: Sequence[float] | None = None):
        super().__init__()
        if slopes is not None:
            self._set(slopes=list(slopes), shifts=list(shifts))

    def _transform(self, df: DataFrame) -> DataFrame:
        pairs = zip(self.getOrDefault(self.slopes), self.getOrDefault(self.shifts))
        sigmoids = F.array(*[_sigmoid(F.lit(a) * F.col("_m")[i] + F.lit(b)) for i, (a, b) in enumerate(pairs)])
        total = F.aggregate("_s", F.lit(0.0), lambda x, v: x + v)
        even = F.transform("_s", lambda v: F.lit(1.0) / F.size("_s"))
        shares = F.when(F.col("_t") > 0, F.transform("_s", lambda v: v / F.col("_t"))).otherwise(even)
        return (df.withColumn("_m", vector_to_array("rawPrediction")).withColumn("_s", sigmoids).withColumn("_t", total)
                  .withColumn("probability", array_to_vector(shares)).drop("_m", "_s", "_t"))


def smoothed_targets(positive: int, total: int) -> tuple[float, float]:
    """What a row of the class, and another row, should get."""
    return (positive + 1) / (positive + 2), 1 / (total - positive + 2)


def fit_sigmoids(margins: DataFrame, classes: int) -> tuple[list[float], list[float]]:
    """(slopes, shifts) of stored rows (y, m): class and margins of all classes."""
    counts = {r["y"]: r["n"] for r in margins.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    have = [counts.get(c, 0) for c in range(classes)]
    targets = [smoothed_targets(p, n) for p in have]
    long = margins.select("y", F.posexplode("m").alias("c", "m"))

    def at(values: Sequence[float]) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("c"))

    t = F.when(F.col("y") == F.col("c"), at([a for a, _ in targets])).otherwise(at([b for _, b in targets]))
    point = np.array([[0.0, math.log((p + 1) / (n - p + 1))] for p in have])
    best, lowest, move = point.copy(), np.full(classes, np.inf), np.zeros_like(point)
    for _ in range(STEPS):
        z = at(point[:, 0]) * F.col("m") + at(point[:, 1])
        p = _sigmoid(z)
        loss = F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
        w, d = p * (1 - p), p - t
        sums = long.groupBy("c").agg(F.sum(loss), F.sum(d), F.sum(d * F.col("m")), F.sum(w), F.sum(w * F.col("m")),
                                     F.sum(w * F.col("m") ** 2)).collect()
        steepest = 0.0
        for r in sums:
            c, value, g0, g1, h00, h01, h11 = r
            if value <= lowest[c] + 1e-12 * n:              # better: take a new step, else half of the last one
                best[c], lowest[c] = point[c], value
                hessian = np.array([[h11, h01], [h01, h00]]) + 1e-9 * n * np.eye(2)
                move[c] = -np.linalg.solve(hessian, [g1, g0])
                steepest = max(steepest, abs(g0) / n, abs(g1) / n)
            else:
                move[c] /= 2
                steepest = max(steepest, float(np.abs(move[c]).max()))
            point[c] = best[c] + move[c]
        if steepest < 1e-9:
            break
    return best[:, 0].tolist(), best[:, 1].tolist()


class CalibratedSVM(Estimator, Columns):
    def __init__(self, reg: float = 0.0, max_iter: int = 100, parallelism: int = 8, featuresCol: str = "features",
                 labelCol: str = "label", weightCol: str | None = None, folds: int = FOLDS, seed: int = 42):
        super().__init__()
        self.reg, self.max_iter, self.parallelism = reg, max_iter, parallelism
        self.weight, self.folds, self.seed = weightCol, folds, seed
        self._columns(featuresCol, labelCol)

    def _margins_model(self, df: DataFrame, features: str, label: str):
        more = {"weightCol": self.weight} if self.weight else {}
        return OneVsRest(classifier=LinearSVC(regParam=self.reg, maxIter=self.max_iter), parallelism=self.parallelism,
                         featuresCol=features, labelCol=label, **more).fit(df)

    def unseen_margins(self, df: DataFrame) -> DataFrame:
        """Stored (y, m): every row's margins from a model fitted without its part."""
        keep = [F.col(self.features).alias("x"), F.col(self.label).cast("double").alias("y")]
        keep += [F.col(self.weight)] if self.weight else []
        rows = materialise(df.where(F.col(self.label).isNotNull()).select(*keep)
                             .withColumn("id", F.monotonically_increasing_id()), "svm-rows")
        parts = materialise(hash_rank(rows, "id", f"{self.seed}-calibration", ["y"])
                            .withColumn("part", F.col("_rank") % self.folds).drop("_rank", "_size"), "svm-parts")
        classes = int(parts.agg(F.max("y")).first()[0]) + 1
        out = None
        for f in range(self.folds):
            rest = parts.where(F.col("part") != f)
            if rest.isEmpty():
                continue
            model = self._margins_model(rest, "x", "y")
            raw = model.transform(parts.where(F.col("part") == f)).select(
                F.col("y").cast("int").alias("y"), vector_to_array("rawPrediction").alias("r"))
            m = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.coalesce(F.get("r", c), F.lit(ABSENT)))
            part = materialise(raw.select("y", m.alias("m")), "svm-margins")
            out = part if out is None else out.unionByName(part)
        return out

    def _fit(self, df: DataFrame) -> PipelineModel:
        margins = self.unseen_margins(df)
        model = self._margins_model(df, self.features, self.label)
        slopes, shifts = fit_sigmoids(margins, len(model.models))
        return PipelineModel([model, SigmoidProbability(slopes, shifts)])
