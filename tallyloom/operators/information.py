"""Mutual information of vector components with a label, by neighbour distances or by quantile bins.

The neighbour estimator compares densities: around each row, as far as the ``k``-th nearest row of its own class on
one feature, it counts the rows of all classes. Per feature

    score = digamma(N) - mean digamma(N_class) + mean digamma(own rows inside) - mean digamma(all rows inside),

not below 0, over the rows of classes with two rows or more; a class with at most ``k`` others uses all of them. "Inside"
is nearer than the k-th distance, the row itself included; where that distance is 0, inside are the equal rows.

Equal rows are counted first. Cells are numbered by exact running totals and cut into blocks of ``BLOCK`` consecutive
cells, each with the ``k`` cells before and after it, so one class may hold all rows. Rows inside a radius are differences
of one running total over values and radius ends together: two ends per cell, no pairs.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scale import materialise, running_total
from tallyloom.operators import profile

NEIGHBORS = 3
BLOCK = 65_536


def digamma(n: Column) -> Column:
    """For whole n >= 1: shifted by 6, then the asymptotic series."""
    n = n.cast("double")
    x = n + 6
    early = sum((F.lit(1.0) / (n + j) for j in range(1, 6)), F.lit(1.0) / n)
    s = F.lit(1.0) / (x * x)
    series = s * (F.lit(1 / 12) - s * (F.lit(1 / 120) - s * (F.lit(1 / 252) - s * F.lit(1 / 240))))
    return F.ln(x) - F.lit(0.5) / x - series - early


def component_cells(df: DataFrame, features: str, label: str) -> DataFrame:
    """(feature, y, x, n): how often a value of a component occurs in a class. Null labels and non-finite values are left out."""
    long = df.where(F.col(label).isNotNull()).select(
        F.col(label).alias("y"), F.posexplode(vector_to_array(features)).alias("feature", "x"))
    finite = ~F.isnan("x") & (F.abs("x") < F.lit(float("inf")))
    return long.where(finite).groupBy("feature", "y", (F.col("x") + 0.0).alias("x")).agg(F.count(F.lit(1)).alias("n"))


def own_distances(cells: DataFrame, k: int, block: int, limit: int | None = None) -> DataFrame:
    """(feature, y, x, n, n_y, d, own): distance of the k-th nearest other row of the class, own rows inside it."""
    sizes = cells.groupBy("feature", "y").agg(F.sum("n").alias("n_y"))
    sized = cells.join(F.broadcast(sizes), ["feature", "y"]).where("n_y > 1")      # classes x features rows
    placed = running_total(sized, ["feature", "y"], ["x"], "_at", None, limit)
    home = F.floor(F.col("_at") / block)
    sent = placed.withColumn("_home", home).withColumn("_block", F.explode(F.array_distinct(F.array(
        home, F.floor((F.col("_at") - k) / block), F.floor((F.col("_at") + k) / block)))))
    near = Window.partitionBy("feature", "y", "_block").orderBy("x").rowsBetween(-k, k)
    around = sent.withColumn("_near", F.collect_list(F.struct("x", "n")).over(near)).where("_home = _block")
    away = F.sort_array(F.transform("_near", lambda v: F.struct(
        F.abs(v["x"] - F.col("x")).alias("d"),
        F.when(v["x"] == F.col("x"), v["n"] - 1).otherwise(v["n"]).alias("n"))))
    wanted = F.least(F.lit(k).cast("long"), F.col("n_y") - 1)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d"))
    reached = F.aggregate("_away", start, lambda got, v: F.when(got["n"] >= wanted, got).otherwise(
        F.struct((got["n"] + v["n"]).alias("n"), v["d"].alias("d"))))
    inside = F.aggregate(F.filter("_away", lambda v: (v["d"] < F.col("d")) | (v["d"] == 0)), F.lit(1).cast("long"),
                         lambda s, v: s + v["n"])
    return (around.withColumn("_away", away).withColumn("d", reached["d"]).withColumn("own", inside)
                  .select("feature", "y", "x", "n", "n_y", "d", "own"))


def neighbor_information(df: DataFrame, features: str = "features", label: str = "label", k: int = NEIGHBORS,
                         block: int = BLOCK, limit: int | None = None) -> DataFrame:
    """(feature, score) in nats by k-th neighbour distances; features without a usable row are left out."""
    if not 1 <= k <= block:
        raise ValueError("k must lie between 1 and the block size")
    cells = materialise(component_cells(df, features, label), "cells")
    own = materialise(own_distances(cells, k, block, limit), "distances")
    values = own.groupBy("feature", "x").agg(F.sum("n").alias("w")).select(
        "feature", F.col("x").alias("at"), F.lit(1).alias("kind"), "w",
        *[F.lit(None).cast(t).alias(c) for c, t in (("y", own.schema["y"].dataType), ("x", "double"), ("sign", "int"))])

    def end(at: Column, kind: int, sign: int) -> DataFrame:
        """Rows below ``at`` (kind 0) or up to it (kind 2)."""
        strict = F.col("d") > 0
        return own.select("feature", at.alias("at"), F.when(strict, kind).otherwise(2 - kind).alias("kind"),
                          F.lit(0).cast("long").alias("w"), "y", "x", F.lit(sign).alias("sign"))

    events = values.unionByName(end(F.col("x") - F.col("d"), 2, -1)).unionByName(end(F.col("x") + F.col("d"), 0, 1))
    counted = running_total(events, ["feature"], ["at", "kind"], "_rows", "w", limit)
    whole = counted.where(F.col("sign").isNotNull()).groupBy("feature", "y", "x").agg(
        F.sum(F.col("sign") * F.col("_rows")).alias("all"))
    terms = own.join(whole, ["feature", "y", "x"])
    n = F.col("n").cast("double")
    part = terms.groupBy("feature").agg(
        F.sum("n").alias("t"), F.sum(n * (digamma(F.col("own")) - digamma(F.col("all")) - digamma(F.col("n_y")))).alias("s"))
    return part.select("feature", F.greatest(digamma(F.col("t")) + F.col("s") / F.col("t"), F.lit(0.0)).alias("score"))


def quantile_information(df: DataFrame, features: str = "features", label: str = "label", bins: int = 10,
                         limit: int | None = None) -> DataFrame:
    """(feature, score) in nats between bins of equal row counts and the label; edges are exact quantiles.

    Bin b holds the values above the b-th edge and up to the next; equal edges leave bins empty.
    """
    cells = materialise(component_cells(df, features, label), "cells")
    values = cells.groupBy("feature", F.col("x").alias("value")).agg(F.sum("n").alias("n"))
    edges = profile.quantiles_of(materialise(running_total(values, ["feature"], ["value"], "upto", "n", limit), "values"),
                                 [i / bins for i in range(1, bins)])
    placed = cells.join(F.broadcast(edges), "feature")                            # one row per feature
    binned = placed.groupBy("feature", F.size(F.filter("q", lambda e: e < F.col("x"))).alias("b"), "y").agg(
        F.sum("n").cast("double").alias("n_xy"))
    of = Window.partitionBy("feature")                                             # bins x classes rows
    b, y = Window.partitionBy("feature", "b"), Window.partitionBy("feature", "y")
    return (binned.withColumns({"n_x": F.sum("n_xy").over(b), "n_y": F.sum("n_xy").over(y), "n": F.sum("n_xy").over(of)})
                  .groupBy("feature").agg(F.sum(profile.entropy_terms(
                      F.col("n_xy"), F.col("n_x"), F.col("n_y"), F.col("n"))).alias("score")))
