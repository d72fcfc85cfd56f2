"""Choosing and combining models by vote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.scale import bounded_rows
from tallyloom.operators.models import argmax_label

VOTING_PREFIX = "Voting_"


def select_best_models(summary: DataFrame, n_models: int = 3,
                       metric: str = "balanced_accuracy-val") -> DataFrame:
    """(Model, rank): the best stage of each model family, then the best ``n_models`` of those.

    The family is the part of the name before the first '_'; earlier ensembles are left out.
    """
    c = F.col(f"`{metric}`")
    base = (summary.where(~F.col("Model").startswith(VOTING_PREFIX))
            .withColumn("family", F.substring_index("Model", "_", 1)))
    best = Window.partitionBy("family").orderBy(c.desc_nulls_last(), "Model")
    firsts = base.withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
    order = Window.partitionBy().orderBy(c.desc_nulls_last(), "Model")    # one row per family
    return (firsts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_models)
            .select("Model", "rank"))


def choose_members(summary: DataFrame, n_models: int = 3, metric: str = "balanced_accuracy-val",
                   manual_selection: Sequence[str] | None = None) -> list[str]:
    """Stage names by rank, or the manual list if one is given; unknown names are an error."""
    if manual_selection:
        known = {r[0] for r in bounded_rows(summary.select("Model").distinct(), 100_000, "models")}
        unknown = sorted(set(manual_selection) - known)
        if unknown:
            raise ValueError(f"unknown models: {unknown}")
        return list(manual_selection)
    rows = bounded_rows(select_best_models(summary, n_models, metric), n_models, "members")
    return [r["Model"] for r in sorted(rows, key=lambda r: r["rank"])]


def ensembles_by_size(summary: DataFrame, sizes: Sequence[int] = (4, 5, 6, 7),
                      metric: str = "balanced_accuracy-val") -> DataFrame:
    """(ensemble, size, Model, rank): members of every ensemble size in one ranking pass."""
    ranked = select_best_models(summary, max(sizes), metric)
    size = F.explode(F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n >= F.col("rank")))
    return ranked.withColumn("size", size).select(
        F.concat(F.lit(VOTING_PREFIX), F.col("size").cast("string")).alias("ensemble"),
        "size", "Model", "rank")


def soft_vote(predictions: DataFrame, n_classes: int, row: str = "row_id",
              by: Sequence[str] = ()) -> DataFrame:
    """Mean probability per class over the members, then the most probable class.

    ``predictions`` holds one row per (row, model) with an array ``probability``; classes a member
    does not know count as 0 and ties go to the smaller class. One shuffle on the row key, with
    partial means before it.
    """
    means = predictions.groupBy(*by, row).agg(F.array(*[
        F.round(F.avg(F.coalesce(F.get("probability", F.lit(c)), F.lit(0.0))), 12)
        for c in range(n_classes)]).alias("_m"))
    return means.select(*by, row, argmax_label(F.col("_m")).cast("int").alias("prediction"),
                        F.array_max("_m").alias("p"))


def hard_vote(predictions: DataFrame, row: str = "row_id", by: Sequence[str] = ()) -> DataFrame:
    """The class most members predict; ties go to the smaller class."""
    counts = predictions.groupBy(*by, row, "prediction").agg(F.count(F.lit(1)).alias("votes"))
    return counts.groupBy(*by, row).agg(
        F.min_by("prediction", F.struct(-F.col("votes"), F.col("prediction"))).alias("winner"),
        F.max("votes").alias("votes")).withColumnRenamed("winner", "prediction")


class VotingModel(Model):
    """Fitted members applied side by side on each row: no join and no shuffle."""

    def __init__(self, members: Sequence[Model], voting: str = "soft", n_classes: int = 2):
        super().__init__()
        if voting not in ("soft", "hard"):
            raise ValueError("voting must be 'soft' or 'hard'")
        self.members, self.voting, self.n_classes = list(members), voting, n_classes

    def save(self, path: str, spark: SparkSession) -> None:
        """Members and settings in one folder."""
        for i, m in enumerate(self.members):
            m.write().overwrite().save(f"{path}/member-{i}")
        spark.createDataFrame([(self.voting, self.n_classes, len(self.members))],
                              "voting string, n_classes int, n_members int").coalesce(1).write.mode(
            "overwrite").json(f"{path}/settings")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "VotingModel":
        made = spark.read.schema("voting string, n_classes int, n_members int").json(f"{path}/settings").first()
        members = [PipelineModel.load(f"{path}/member-{i}") for i in range(made["n_members"])]
        return cls(members, made["voting"], made["n_classes"])

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        out = df
        for i, m in enumerate(self.members):
            done = m.transform(out.select(*keep, *[f"_p{j}" for j in range(i)]))
            if self.voting == "soft":
                got = vector_to_array("probability")
            else:
                got = F.transform(F.sequence(F.lit(0), F.lit(self.n_classes - 1)),
                                  lambda c: (c == F.col("prediction").cast("int")).cast("double"))
            out = done.select(*keep, *[f"_p{j}" for j in range(i)], got.alias(f"_p{i}"))
        n = float(len(self.members))
        mean = F.transform(F.sequence(F.lit(0), F.lit(self.n_classes - 1)), lambda c: F.round(
            sum(F.coalesce(F.get(F.col(f"_p{i}"), c), F.lit(0.0)) for i in range(len(self.members)))
            / n, 12))
        return (out.withColumn("_m", mean).withColumn("prediction", argmax_label(F.col("_m")))
                   .withColumn("probability", array_to_vector("_m"))
                   .drop("_m", *[f"_p{i}" for i in range(len(self.members))]))
