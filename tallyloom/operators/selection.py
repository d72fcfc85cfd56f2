"""Feature selection on a vector column; every selector fits to a Spark ML transformer."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.scale import bounded_rows, materialise
from tallyloom.operators.evaluate import average_metrics, confusion
from tallyloom.operators.information import neighbor_information, quantile_information
from tallyloom.operators.profile import entropy_terms
from tallyloom.operators.split import stratified_folds

CELLS_AT_ONCE = 1_000_000   # vector components binned together in a task
PARALLEL_FOLDS = 4   # folds of the recursive elimination evaluated side by side

# The driver-side decomposition behind PCA is not safe to run from several threads at once.
_DECOMPOSITION = threading.Lock()

# Search spaces of the selectors.
SELECTOR_SPACES: dict[str, dict] = {
    "none": {},
    "mi": {"k": [5, 10, 20, 30, 40, 50, "all"]},
    "pca": {"n_components": {"type": "float", "range": [0.5, 0.99],
                             "values": [0.7, 0.8, 0.85, 0.9, 0.95, 0.99]}},
    "rf": {"max_features": [1, 5, 10, 20, 50, None], "threshold": ["mean", "median", 0.1, 0.2]},
    "rfe": {"min_features_to_select": {"type": "int", "range": [5, 50]},
            "step": {"type": "float", "values": [0.1, 0.2, 0.3]}},
}


def _slicer(indices: Sequence[int], source: str, out: str) -> VectorSlicer:
    return VectorSlicer(inputCol=source, outputCol=out, indices=[int(i) for i in sorted(indices)])


def _bin_counts(known: DataFrame, features: str, label: str, lo: np.ndarray, width: np.ndarray, bins: int) -> DataFrame:
    """(feature, b, y, n) for every Arrow batch: rows in a bin of equal width with a label. NaN falls into bin 0."""
    def count(batches):
        for batch in batches:
            y = batch.column(0).dictionary_encode()
            labels, at = len(y.dictionary), y.indices.to_numpy(zero_copy_only=False).astype("int64")
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(lo))
            step = max(CELLS_AT_ONCE // max(len(lo), 1), 1)
            for i in range(0, batch.num_rows, step):
                with np.errstate(all="ignore"):
                    place = np.floor((x[i:i + step] - lo) * bins / width)
                place = np.minimum(np.where(np.isnan(place), 0, place), bins - 1).astype("int64")
                code = (np.arange(len(lo)) * bins + place) * labels + at[i:i + step, None]
                if len(lo) * bins * labels <= CELLS_AT_ONCE:
                    found = np.bincount(code.ravel())
                    cells = np.flatnonzero(found)
                    n = found[cells]
                else:
                    cells, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells // (bins * labels), pa.int32()), pa.array(cells // labels % bins, pa.int64()),
                     y.dictionary.take(pa.array(cells % labels)), pa.array(n, pa.int64())], ["feature", "b", "y", "n"])

    kind = known.schema[label].dataType
    out = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("b", T.LongType()),
                        T.StructField("y", kind), T.StructField("n", T.LongType())])
    return known.select(F.col(label).alias("y"), vector_to_array(features).alias("x")).mapInArrow(count, out)


def mutual_information(df: DataFrame, features: str = "features", label: str = "label",
                       bins: int = 10) -> DataFrame:
    """(feature, score): mutual information in nats between equal-width bins and the label.

    Two passes: the ranges, then counts per (feature, bin, label) that are summed per batch of rows,
    so only a few cells per feature are shuffled.
    """
    known = df.where(F.col(label).isNotNull())
    ends = known.agg(Summarizer.metrics("min", "max").summary(F.col(features)).alias("s")
                     ).select("s.min", "s.max").first()
    lo, hi = ends[0].toArray(), ends[1].toArray()
    with np.errstate(over="ignore"):                                               # a range beyond the largest double
        width = hi - lo
    cells = _bin_counts(known, features, label, lo, width, bins).groupBy("feature", "b", "y").agg(
        F.sum("n").cast("double").alias("n_xy"))
    of = Window.partitionBy("feature")                                             # bins x classes rows
    b, y = Window.partitionBy("feature", "b"), Window.partitionBy("feature", "y")
    return (cells.withColumns({"n_x": F.sum("n_xy").over(b), "n_y": F.sum("n_xy").over(y), "n": F.sum("n_xy").over(of)})
            .groupBy("feature").agg(F.sum(entropy_terms(
                F.col("n_xy"), F.col("n_x"), F.col("n_y"), F.col("n"))).alias("score")))


class MutualInformationSelector(Estimator):
    """The k features of highest mutual information ('all' keeps every one).

    ``estimator``: 'bins' (a number of equal width, or 'quantile' for ten of equal counts) or 'neighbors'.
    """

    def __init__(self, k: int | str = 10, bins: int | str = 10, features: str = "features",
                 label: str = "label", out: str = "selected", estimator: str = "bins", n_neighbors: int = 3):
        super().__init__()
        if estimator not in ("bins", "neighbors") or isinstance(bins, str) and bins != "quantile":
            raise ValueError(f"unknown estimator {estimator} with bins {bins}")
        self.k, self.bins, self.names = k, bins, (features, label, out)
        self.estimator, self.n_neighbors = estimator, n_neighbors

    def scores(self, df: DataFrame) -> DataFrame:
        features, label, _ = self.names
        if self.estimator == "neighbors":
            return neighbor_information(df, features, label, self.n_neighbors)
        if self.bins == "quantile":
            return quantile_information(df, features, label)
        return mutual_information(df, features, label, self.bins)

    def _fit(self, df: DataFrame) -> Model:
        features, label, out = self.names
        ranked = self.scores(df)
        n = (df.select(F.size(vector_to_array(features))).first()[0] if self.k == "all"     # one score per column
             else int(self.k))
        rows = bounded_rows(ranked.orderBy(F.desc("score"), "feature").limit(n), n, "features")
        return PipelineModel([_slicer([r["feature"] for r in rows], features, out)])


class PCASelector(Estimator):
    """Centred principal components: a share of the variance (< 1) or a number of components."""

    def __init__(self, n_components: float | int = 0.95, features: str = "features",
                 out: str = "selected"):
        super().__init__()
        self.n_components, self.names = n_components, (features, out)

    def _fit(self, df: DataFrame) -> Model:
        features, out = self.names
        width = df.select(F.size(vector_to_array(features))).first()[0]
        centre = StandardScaler(inputCol=features, outputCol="_centred", withMean=True,
                                withStd=False).fit(df)
        with _DECOMPOSITION:
            pca = PCA(k=width, inputCol="_centred", outputCol="_components").fit(centre.transform(df))
        if self.n_components < 1:
            share = np.cumsum(pca.explainedVariance.toArray())
            keep = min(int(np.searchsorted(share, self.n_components, side="right")) + 1, width)
        else:
            keep = min(int(self.n_components), width)
        return PipelineModel([centre, pca, _slicer(range(keep), "_components", out)])


def forest_importances(df: DataFrame, features: str = "features", label: str = "label",
                       trees: int = 100, depth: int = 10, seed: int = 42) -> np.ndarray:
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol=features,
                                    labelCol=label)
    return forest.fit(df).featureImportances.toArray()


class ForestSelector(Estimator):
    """Features whose forest importance reaches 'mean', 'median' or a number."""

    def __init__(self, threshold: str | float = "mean", max_features: int | None = None,
                 trees: int = 100, depth: int = 10, features: str = "features",
                 label: str = "label", out: str = "selected"):
        super().__init__()
        self.threshold, self.max_features = threshold, max_features
        self.forest, self.names = (trees, depth), (features, label, out)

    def _fit(self, df: DataFrame) -> Model:
        features, label, out = self.names
        imp = forest_importances(df, features, label, *self.forest)
        cut = {"mean": imp.mean(), "median": np.median(imp)}.get(self.threshold, self.threshold)
        order = sorted(range(len(imp)), key=lambda i: (-imp[i], i))
        keep = [i for i in order if imp[i] >= float(cut)][:self.max_features]
        return PipelineModel([_slicer(keep or order[:1], features, out)])


def elimination_sizes(width: int, least: int, step: float) -> list[int]:
    """Feature counts visited by recursive elimination, widest first."""
    sizes, n = [width], width
    drop = max(int(step * width), 1) if step < 1 else int(step)
    while n > least:
        n = max(n - drop, least)
        sizes.append(n)
    return sizes


class EliminationSelector(Estimator):
    """Recursive elimination: forests drop the weakest features step by step in every fold; the
    width with the best mean balanced accuracy wins and is refitted on all rows.

    The folds are the selector's own, dealt by class over the hash of ``key`` (of the vector where the
    rows have no key), whatever folds a surrounding search uses. Fewer folds than ``k`` are used where the smallest class is smaller.
    """

    def __init__(self, min_features_to_select: int = 10, step: float = 0.1, key: str = "row_id",
                 k: int = 5, trees: int = 100, depth: int = 10, features: str = "features",
                 label: str = "label", out: str = "selected"):
        super().__init__()
        self.least, self.step, self.key, self.k = min_features_to_select, step, key, k
        self.forest, self.names = (trees, depth), (features, label, out)
        self.scores: list[tuple[int, int, float]] = []

    def _folded(self, df: DataFrame) -> DataFrame:
        """(features, label, _inner), stored."""
        features, label, _ = self.names
        vector = F.transform(vector_to_array(features), lambda x: x.cast("string"))
        key = F.col(self.key).cast("string") if self.key in df.columns else F.sha2(F.concat_ws(",", vector), 256)
        rows = df.select(F.col(features), F.col(label), key.alias("_row"))
        dealt = stratified_folds(rows, label, "_row", self.k).withColumnRenamed("fold", "_inner")
        return materialise(dealt.select(features, label, "_inner"), "elimination")

    def _forest(self):
        features, label, _ = self.names
        return RandomForestClassifier(numTrees=self.forest[0], maxDepth=self.forest[1], seed=42,
                                      featuresCol="_kept", labelCol=label)

    def _path(self, train: DataFrame, sizes: list[int], test: DataFrame | None, fold: int):
        """Kept feature sets by width; with a test side also the score of every width."""
        features, label, _ = self.names
        kept, by_size = list(range(sizes[0])), {}
        for i, n in enumerate(sizes):
            by_size[n] = list(kept)
            last = i + 1 == len(sizes)
            if last and test is None:
                break
            slicer = _slicer(kept, features, "_kept")
            model = self._forest().fit(slicer.transform(train))
            if test is not None:
                cells = confusion(model.transform(slicer.transform(test)), label=label)
                self.scores.append((fold, n, average_metrics(cells).first()["balanced_accuracy"]))
            if not last:
                imp = model.featureImportances.toArray()
                order = sorted(range(len(kept)), key=lambda j: (-imp[j], j))
                kept = sorted(kept[j] for j in order[:sizes[i + 1]])
        return by_size

    def _fit(self, df: DataFrame) -> Model:
        features, _, out = self.names
        width = df.select(F.size(vector_to_array(features))).first()[0]
        sizes = elimination_sizes(width, min(self.least, width), self.step)
        self.scores = []
        rows = self._folded(df)
        folds = sorted(r[0] for r in bounded_rows(rows.select("_inner").distinct(), self.k, "folds"))
        if len(folds) < 2:
            raise ValueError("elimination needs rows for at least two folds")

        def one(f: int) -> None:
            self._path(rows.where(F.col("_inner") != f), sizes, rows.where(F.col("_inner") == f), f)

        with ThreadPoolExecutor(max_workers=PARALLEL_FOLDS) as pool:
            for r in [pool.submit(inheritable_thread_target(df.sparkSession)(one), f) for f in folds]:
                r.result()
        mean = {n: np.mean([s for _, m, s in self.scores if m == n]) for n in sizes}
        best = min(sizes, key=lambda n: (-mean[n], n))
        upto = sizes[:sizes.index(best) + 1]
        return PipelineModel([_slicer(self._path(df, upto, None, -1)[best], features, out)])


def build_selector(name: str, params: dict | None = None, features: str = "features",
                   label: str = "label", out: str = "selected") -> Estimator | None:
    params = dict(params or {})
    if name == "none":
        return None
    if name == "pca":
        return PCASelector(params.get("n_components", 0.95), features, out)
    kinds = {"mi": MutualInformationSelector, "rf": ForestSelector, "rfe": EliminationSelector}
    if name not in kinds:
        raise ValueError(f"unknown selector {name!r}")
    return kinds[name](**params, features=features, label=label, out=out)


def kept_features(model: PipelineModel) -> list[int]:
    """Input positions (or component numbers) a fitted selector passes on."""
    return list(model.stages[-1].getIndices())


def feature_info(stage: str, selector: str, model: PipelineModel | None, names: Sequence[str],
                 spark) -> DataFrame:
    """(stage, selector, n_input, n_selected, feature) rows of a fitted stage."""
    if model is None:
        kept = list(names)
    elif selector == "pca":
        kept = [f"PC{i + 1}" for i in kept_features(model)]
    else:
        kept = [names[i] for i in kept_features(model)]
    return spark.createDataFrame([(stage, selector, len(names), len(kept), f) for f in kept],
                                 "stage string, selector string, n_input int, n_selected int, feature string")
