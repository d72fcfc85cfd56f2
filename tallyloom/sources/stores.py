"""Metric, trial, report and model stores on the file system Spark writes to."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scale import bounded_rows
from tallyloom.operators.ensemble import VotingModel
from tallyloom.operators.evaluate import AVG_METRICS, class_scores, long_metrics, nested_report

# one record per stage: its settings beside a map of metrics for each split, and by split the class
# report as JSON text and the counted cells of the confusion matrix; ``parameters`` holds the
# hyperparameters once more as JSON, which keeps their types
METRICS_SCHEMA = ("stage_name string, training_type string, cv_score double, seconds double, "
                  "train_metrics map<string,double>, val_metrics map<string,double>, "
                  "test_metrics map<string,double>, hyperparameters map<string,string>, "
                  "classes array<string>, features array<string>, class_reports map<string,string>, "
                  "confusion map<string,array<struct<label:double,prediction:double,n:bigint>>>, parameters string")
MODELS_SCHEMA = "stage string, path string, saved_at timestamp, kind string"


def metric_records(metrics: DataFrame, info: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Long (stage, split, metric, value) rows as nested records beside what ``info`` says of the stage:
    (stage, training_type, cv_score, seconds, further columns of the schema). Stages that ``info``
    lacks keep their metrics. ``cells`` (stage, split, label, prediction, n) add reports and matrices."""
    def of(split: str):
        entry = F.when(F.col("split") == split, F.struct(F.col("metric"), F.col("value")))
        return F.map_from_entries(F.collect_list(entry))     # a handful of metrics per stage
    nested = metrics.groupBy("stage").agg(*[of(s).alias(f"{s}_metrics") for s in ("train", "val", "test")])
    more = [c for c in ("hyperparameters", "classes", "features", "parameters") if c in info.columns]
    out = nested.join(info, "stage", "left")
    if cells is not None:
        by = ["stage", "split"]
        reports = encode_report(nested_report(class_scores(cells, by), by)).groupBy("stage").agg(
            F.map_from_entries(F.collect_list(F.struct("split", "report"))).alias("class_reports"))
        cell = F.struct(*[F.col(c).cast("double").alias(c) for c in ("label", "prediction")], "n")
        grids = cells.groupBy(*by).agg(F.sort_array(F.collect_list(cell)).alias("g")).groupBy("stage").agg(
            F.map_from_entries(F.collect_list(F.struct("split", "g"))).alias("confusion"))  # classes squared
        out, more = out.join(reports, "stage", "left").join(grids, "stage", "left"), [*more, "class_reports", "confusion"]
    return out.select(
        F.col("stage").alias("stage_name"), "training_type", "cv_score", "seconds",
        "train_metrics", "val_metrics", "test_metrics", *more)


def save_metrics(records: DataFrame, path: str) -> None:
    """Write nested records as JSON, one folder per stage; a stage written before is replaced."""
    (records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage_name").json(path))


def load_all_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path)


def load_metrics(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """The records of one stage; no rows when there are none. Only its folder is read."""
    return load_all_metrics(spark, path).where(F.col("stage_name") == stage)


def stored_parameters(records: DataFrame) -> dict[str, dict]:
    """stage -> the parameters it was trained with, of the stages that have any (a row per stage of a sweep)."""
    rows = bounded_rows(records.where("parameters is not null").select("stage_name", "parameters"), 10_000, "stages")
    return {r["stage_name"]: json.loads(r["parameters"]) for r in rows}


def flat_metrics(records: DataFrame) -> DataFrame:
    """Stage, training type, cross-validation score and one column per test metric."""
    return records.select(
        "stage_name", "training_type", "cv_score",
        *[F.col("test_metrics")[m].alias(m) for m in AVG_METRICS])


def unpack_metrics(records: DataFrame) -> DataFrame:
    """Back to long (stage, split, metric, value) rows."""
    out = None
    for s in ("train", "val", "test"):
        part = records.select(F.col("stage_name").alias("stage"), F.lit(s).alias("split"),
                              F.explode(f"{s}_metrics").alias("metric", "value"))
        out = part if out is None else out.unionByName(part)
    return out


REPORT_TYPE = "map<string,struct<precision:double,recall:double,`f1-score`:double,support:double>>"


def encode_report(nested: DataFrame, column: str = "report") -> DataFrame:
    """A nested class report as JSON text."""
    return nested.withColumn(column, F.to_json(column))


def decode_report(encoded: DataFrame, column: str = "report") -> DataFrame:
    return encoded.withColumn(column, F.from_json(column, REPORT_TYPE))


def write_report(df: DataFrame, path: str, by_stage: bool = False, stage: str = "stage") -> None:
    """``;``-separated text with a header. ``by_stage``: one folder per stage, of which only those
    of the given stages are written anew."""
    writer = df.write.mode("overwrite").option("sep", ";").option("header", True)
    writer = writer.option("partitionOverwriteMode", "dynamic" if by_stage else "static")
    (writer.partitionBy(stage) if by_stage else writer).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)


def save_trials(trials: DataFrame, path: str) -> None:
    """One folder per stage; the trials of a stage that is run again replace those of the run before."""
    trials.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage").parquet(path)


def load_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stage_metrics(wide: DataFrame) -> DataFrame:
    return long_metrics(wide, ["stage", "split"])


def save_model(model: PipelineModel | VotingModel, root: str, stage: str, saved_at: str, spark: SparkSession) -> str:
    """Store a fitted model and note it in the model catalogue; ``saved_at`` is 'yyyy-MM-dd HH:mm:ss'."""
    stamp = "".join(ch for ch in saved_at if ch.isdigit())
    safe = "".join(ch if ch.isalnum() else "_" for ch in stage)
    path = f"{root}/models/{safe}-{stamp}"
    votes = isinstance(model, VotingModel)
    if votes:
        model.save(path, spark)
    else:
        model.write().overwrite().save(path)
    (spark.range(1).select(F.lit(stage).alias("stage"), F.lit(path).alias("path"),
                           F.to_timestamp(F.lit(saved_at)).alias("saved_at"),
                           F.lit("voting" if votes else "pipeline").alias("kind"))
     .write.mode("append").parquet(f"{root}/catalogue"))
    return path


def latest_models(spark: SparkSession, root: str) -> DataFrame:
    """(stage, path, kind, saved_at): the newest model of every stage, by its exact name."""
    return (spark.read.schema(MODELS_SCHEMA).parquet(f"{root}/catalogue").groupBy("stage")
            .agg(F.max_by("path", F.struct("saved_at", "path")).alias("path"),
                 F.max_by("kind", F.struct("saved_at", "path")).alias("kind"),
                 F.max("saved_at").alias("saved_at")))


def load_model(spark: SparkSession, root: str, stage: str) -> PipelineModel | VotingModel:
    found = latest_models(spark, root).where(F.col("stage") == stage).first()
    if found is None:
        raise ValueError(f"no stored model for stage {stage!r}")
    if found["kind"] == "voting":
        return VotingModel.load(found["path"], spark)
    return PipelineModel.load(found["path"])
