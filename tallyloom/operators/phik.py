"""phi_k: the correlation of a bivariate normal that would give the chi-square found between two binned columns.

Numbers are cut into ``BINS`` bins of equal width, anything else goes by its values. The cells of all requested pairs
are counted in one grouped pass. Per pair, the normal's cell shares over the column's own margins give
the chi-square of any correlation; it starts at the pedestal expected from noise and ends at the largest chi-square
that the table allows. Bisection finds the correlation between; below the pedestal it is 0.

Rows with a null in either column take no part; NaN and infinities count as null. A column with one value has no phi_k
(null). More than ``MAX_VALUES`` values of a column are an error, so a pair's table is bounded.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.expr import col
from tallyloom.functions.scale import bounded_rows
from tallyloom.operators.profile import finite_or_null

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 10
MAX_VALUES = 1000
NODES = 64            # of the quadrature over the correlation angle
STEPS = 50            # halvings


def normal_below(edges_x: np.ndarray, edges_y: np.ndarray, rho: float) -> np.ndarray:
    """P(X <= x, Y <= y) of a standard bivariate normal at every pair of edges (which may be infinite)."""
    phi = np.vectorize(NormalDist().cdf, otypes=[float])
    px, py = phi(edges_x), phi(edges_y)
    if rho >= 1.0:
        return np.minimum(px[:, None], py[None, :])
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    top = math.asin(rho)
    x = np.where(np.isfinite(edges_x), edges_x, 0.0)[:, None]
    y = np.where(np.isfinite(edges_y), edges_y, 0.0)[None, :]
    extra = np.zeros((len(edges_x), len(edges_y)))
    for t, w in zip((nodes + 1) * top / 2, weights * top / 2):
        extra += w * np.exp(-(x * x + y * y - 2 * x * y * math.sin(t)) / (2 * math.cos(t) ** 2))
    inner = np.isfinite(edges_x)[:, None] & np.isfinite(edges_y)[None, :]
    return px[:, None] * py[None, :] + np.where(inner, extra / (2 * math.pi), 0.0)


def normal_cells(share_x: np.ndarray, share_y: np.ndarray, rho: float) -> np.ndarray:
    """Cell shares of the bivariate normal cut where its margins have the given shares."""
    def edges(share: np.ndarray) -> np.ndarray:
        inner = [NormalDist().inv_cdf(min(max(p, 1e-300), 1 - 1e-16)) for p in np.cumsum(share)[:-1]]
        return np.array([-np.inf, *inner, np.inf])
    below = normal_below(edges(share_x), edges(share_y), rho)
    return np.maximum(np.diff(np.diff(below, axis=0), axis=1), 0.0)


def pearson_chi2(table: np.ndarray) -> float:
    n = table.sum()
    expected = table.sum(axis=1)[:, None] * table.sum(axis=0)[None, :] / n
    return float(((table - expected) ** 2 / expected).sum())


def pedestal(shape: tuple[int, int]) -> float:
    dof = (shape[0] - 1) * (shape[1] - 1)
    return dof + math.sqrt(2 * dof)


def phi_k(table: np.ndarray) -> float:
    """Of a table of counts without empty rows or columns, at least two of each."""
    n, chi2, noise = table.sum(), pearson_chi2(table), pedestal(table.shape)
    most = n * (min(table.shape) - 1)
    if chi2 <= noise or most <= noise:
        return 0.0
    x, y = table.sum(axis=1) / n, table.sum(axis=0) / n
    independent = x[:, None] * y[None, :]

    def at(rho: float) -> float:
        return float(((normal_cells(x, y, rho) - independent) ** 2 / independent).sum())

    whole = at(1.0)
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        if noise + (most - noise) * at(middle) / whole < chi2:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def _codes(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Every column as the text of its value, or of its bin: numbers have ``bins`` of equal width."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numbers = [c for c in columns if isinstance(kinds[c], T.NumericType)]
    ends = {}
    if numbers:
        row = df.agg(*[f(finite_or_null(c)).cast("double").alias(f"{n}{i}") for i, c in enumerate(numbers)
                       for n, f in (("lo", F.min), ("hi", F.max))]).first()
        ends = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(numbers)}

    def code(c: str):
        if c not in ends:
            return col(c).cast("string")
        lo, hi = ends[c]
        if lo is None or lo == hi:
            return finite_or_null(c).cast("string")
        place = F.floor((finite_or_null(c).cast("double") - F.lit(lo)) * bins / F.lit(hi - lo))
        return F.lpad(F.when(place < bins, place).when(place.isNotNull(), bins - 1).cast("string"), 4, "0")

    return df.select(*[code(c).alias(f"c{i}") for i, c in enumerate(columns)])


def phi_k_pairs(df: DataFrame, columns: Sequence[str], bins: int = BINS, max_values: int = MAX_VALUES) -> DataFrame:
    """(f1, f2, n, rows, columns, chi2, phi_k) of every pair of the columns, in their order.

    The text of a value orders categories; numbers go by their bin.
    """
    spark, k = df.sparkSession, len(columns)
    coded = _codes(df, columns, bins)
    widest = bounded_rows(coded.agg(*[F.approx_count_distinct(f"c{i}").alias(f"c{i}") for i in range(k)]), 1, "widths")[0]
    for i, c in enumerate(columns):
        if widest[f"c{i}"] > max_values:
            raise ValueError(f"column {c}: more than {max_values} values")
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y"))
             for i, j in pairs]
    counted = (coded.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
                    .where(F.col("x").isNotNull() & F.col("y").isNotNull())
                    .groupBy("i", "j", "x", "y").agg(F.count(F.lit(1)).alias("n")))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        table = part.pivot(index="x", columns="y", values="n").fillna(0).sort_index().sort_index(axis=1).to_numpy(float)
        known = min(table.shape) > 1
        return pd.DataFrame({"i": part["i"].iloc[:1], "j": part["j"].iloc[:1], "n": [int(table.sum())],
                             "rows": [table.shape[0]], "columns": [table.shape[1]],
                             "chi2": [pearson_chi2(table) if known else None], "phi_k": [phi_k(table) if known else None]})

    found = counted.groupBy("i", "j").applyInPandas(
        solve, "i int, j int, n long, rows int, columns int, chi2 double, phi_k double")
    names = spark.createDataFrame([(i, j, columns[i], columns[j]) for i, j in pairs], "i int, j int, f1 string, f2 string")
    return names.join(found, ["i", "j"], "left").select("f1", "f2", F.coalesce("n", F.lit(0).cast("long")).alias("n"),
                                                        "rows", "columns", "chi2", "phi_k")
