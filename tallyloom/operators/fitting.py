"""What fitted classifiers share: column parameters, score columns, hash draws and flat decision trees.

A tree that Spark ML has fitted is read once from its description into arrays (feature, threshold, children), at
most 2**(depth + 1) nodes. Tasks then walk whole batches through many trees, on the features the trees use.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, value array<double>"


class Columns(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)

    def _columns(self, features: str, label: str) -> None:
        self._set(featuresCol=features, labelCol=label)

    @property
    def features(self) -> str:
        return self.getOrDefault(self.featuresCol)

    @property
    def label(self) -> str:
        return self.getOrDefault(self.labelCol)


def argmax_label(scores: Column) -> Column:
    """Position of the largest entry, the first one on ties, as a double label."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def draw(key: str, *seed: int | str) -> Column:
    """A number in [0, 1) that depends on the row's key and the seed alone."""
    h = F.xxhash64(F.col(key), F.lit("-".join(map(str, seed))))
    return F.pmod(h, F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def drawn_columns(width: int, share: float, *seed: int | str) -> list[int]:
    """A share of the feature positions (at least one) in hash order, sorted."""
    order = sorted(range(width), key=lambda j: hashlib.md5(f"{j}-{'-'.join(map(str, seed))}".encode()).digest())
    return sorted(order[:max(1, math.ceil(share * width - 1e-9))])


# ---------------------------------------------------------------- flat trees

@dataclass
class FlatTree:
    """Nodes in preorder. ``feature`` is -1 at leaves; ``value`` is (nodes x outputs), read at leaves."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def nodes(self, x: np.ndarray, place: dict[int, int]) -> np.ndarray:
        """The leaf of every row; ``place`` gives the column of a feature in ``x``."""
        at, columns = np.zeros(len(x), np.int64), np.array([place.get(int(f), 0) for f in self.feature])
        rows = np.arange(len(x))
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return at
            here = at[inner]
            low = x[rows[inner], columns[here]] <= self.threshold[here]
            at[inner] = np.where(low, self.left[here], self.right[here])


def flatten(description: str, columns: Sequence[int] | None = None) -> FlatTree:
    """A fitted tree from its text; ``columns`` names the features that its positions stand for."""
    lines = iter(re.findall(r"(If|Else|Predict:)\s*(?:\(feature (\d+) (<=|>) ([^)]*)\)|(\S+))", description))
    rows: list[list] = []

    def read() -> int:
        kind, feature, _, threshold, value = next(lines)
        me = len(rows)
        if kind == "Predict:":
            rows.append([-1, 0.0, -1, -1, float(value)])
            return me
        f = int(feature)
        rows.append([f if columns is None else columns[f], float(threshold), 0, 0, 0.0])
        rows[me][2] = read()
        next(lines)                                         # the line of the other branch
        rows[me][3] = read()
        return me

    read()
    f, t, left, right, value = zip(*rows)
    return FlatTree(np.array(f), np.array(t), np.array(left), np.array(right), np.array(value, float)[:, None])


def used_features(trees: Sequence[FlatTree]) -> list[int]:
    return sorted({int(f) for t in trees for f in t.feature if f >= 0}) or [0]


def used_values(df: DataFrame, features: str, used: list[int], name: str) -> DataFrame:
    """Adds the used features as an array; a sparse vector is never spread out."""
    sliced = VectorSlicer(inputCol="_plain", outputCol="_used", indices=used).transform(
        df.withColumn("_plain", F.col(features)).withMetadata("_plain", {}))
    return sliced.withColumn(name, vector_to_array("_used")).drop("_plain", "_used")


def tree_sums(trees: Sequence[FlatTree], used: list[int], outputs: int, group: Sequence[int]):
    """A column function: used features -> ``outputs`` sums of leaf values; tree i adds to ``group[i]``
    (or, if its values are as many as the outputs, to all of them)."""
    place = {f: i for i, f in enumerate(used)}

    @F.pandas_udf("array<double>")
    def sums(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            x = np.stack(s.to_list()) if len(s) else np.zeros((0, len(used)))
            out = np.zeros((len(x), outputs))
            for t, g in zip(trees, group):
                v = t.value[t.nodes(x, place)]
                if v.shape[1] == 1:
                    out[:, g] += v[:, 0]
                else:
                    out += v
            yield pd.Series(list(out))
    return sums


def save_trees(trees: Sequence[FlatTree], path: str, spark: SparkSession) -> None:
    rows = [(i, n, int(t.feature[n]), float(t.threshold[n]), int(t.left[n]), int(t.right[n]), t.value[n].tolist())
            for i, t in enumerate(trees) for n in range(len(t.feature))]
    spark.createDataFrame(rows, NODES_SCHEMA).write.mode("overwrite").parquet(path)


def load_trees(path: str, spark: SparkSession) -> list[FlatTree]:
    nodes = spark.read.schema(NODES_SCHEMA).parquet(path).toPandas().sort_values(["tree", "node"])  # a model's size
    return [FlatTree(*(g[c].to_numpy() for c in ("feature", "threshold", "left", "right")), np.array(g["value"].to_list()))
            for _, g in nodes.groupby("tree")]
