"""Evaluation tables. Everything derives from counts of (label, prediction) pairs, so the rows are
aggregated once and all later steps work on a few cells per stage and split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.expr import rounded

# Metric names of the reports.
AVG_METRICS = ["balanced_accuracy", "f1-score", "kappa", "precision", "recall"]
REPORT_METRICS = ["precision", "recall", "f1-score", "support"]


def _zero_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """Counts per (label, prediction); pairs that never occur are absent."""
    return (df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction"))
              .agg(F.count(F.lit(1)).alias("n")))


def label_index(df: DataFrame, labels: Sequence[str] = ("label", "prediction")) -> DataFrame:
    """Sorted distinct labels of all given columns with their 0-based position."""
    found = (df.select(F.explode(F.array(*[F.col(c) for c in labels])).alias("class"))
               .where(F.col("class").isNotNull()).distinct())
    return found.select("class", (F.row_number().over(Window.orderBy("class")) - 1).alias("idx"))


def confusion_grid(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The full label x label grid of each stage and split, zeros included.

    Each stage holds as many cells as it has classes squared.
    """
    cells = conf.groupBy(*by).agg(
        F.collect_set("label").alias("a"), F.collect_set("prediction").alias("b"))
    classes = cells.select(*by, F.array_union("a", "b").alias("classes"))
    grid = (classes.select(*by, "classes", F.explode("classes").alias("label"))
                   .select(*by, "label", F.explode("classes").alias("prediction")))
    return (grid.join(conf, [*by, "label", "prediction"], "left")
                .withColumn("n", F.coalesce("n", F.lit(0))))


def confusion_matrix(conf: DataFrame, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """One row per true label, one column per predicted label (``pred_<class>``)."""
    wide = conf.groupBy(*by, "label").pivot("prediction", list(classes)).agg(F.sum("n"))
    return wide.select(*by, "label", *[
        F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"pred_{c}") for c in classes])


def class_counts(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: support (true), predicted and true-positive counts, in one pass over the cells."""
    hit = F.when(F.col("label").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    role = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 zero.alias("predicted"), hit.cast("long").alias("tp")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"),
                 F.col("n").alias("predicted"), zero.alias("tp"))))
    return (conf.select(*by, role.alias("r")).select(*by, "r.*")
                .groupBy(*by, "class").agg(F.sum("support").alias("support"),
                                           F.sum("predicted").alias("predicted"),
                                           F.sum("tp").alias("tp")))


def class_scores(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: precision, recall, f1-score (0 where undefined) and support."""
    counts = class_counts(conf, by)
    p = _zero_div(F.col("tp"), F.col("predicted"))
    r = _zero_div(F.col("tp"), F.col("support"))
    return (counts.withColumn("precision", p).withColumn("recall", r)
                  .withColumn("f1-score", _zero_div(2 * F.col("precision") * F.col("recall"),
                                                    F.col("precision") + F.col("recall"))))


def _totals(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    s, n = F.col("support"), F.sum("support")
    seen = F.sum(F.when(s > 0, 1).otherwise(0))
    aggs = [n.alias("n"), F.try_divide(F.sum("tp"), n).alias("accuracy"),
            F.try_divide(F.sum(F.when(s > 0, F.col("recall"))), seen).alias("balanced_accuracy"),
            F.try_divide(F.sum(s.cast("double") * F.col("predicted")),
                         n.cast("double") * n).alias("chance")]
    for m in ("precision", "recall", "f1-score"):
        aggs.append(F.avg(m).alias(f"macro {m}"))
        aggs.append(F.try_divide(F.sum(F.col(m) * s), n).alias(f"weighted {m}"))
    return scores.groupBy(*by).agg(*aggs)


def classification_report(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class rows, then ``accuracy``, ``macro avg`` and ``weighted avg``, in long-report layout."""
    scores = class_scores(conf, by)
    totals = _totals(scores, by)
    per_class = scores.select(*by, F.col("class").cast("string").alias("class"), "precision",
                              "recall", "f1-score", "support")
    def block(name, kind):
        return F.struct(F.lit(name).alias("class"), *[
            F.col(f"{kind} {m}").alias(m) for m in ("precision", "recall", "f1-score")],
            F.col("n").alias("support"))
    same = F.struct(F.lit("accuracy").alias("class"), F.col("accuracy").alias("precision"),
                    F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1-score"),
                    F.col("n").alias("support"))
    summary = (totals.select(*by, F.explode(F.array(
        same, block("macro avg", "macro"), block("weighted avg", "weighted"))).alias("r"))
        .select(*by, "r.*"))
    return per_class.unionByName(summary)


def average_metrics(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Balanced accuracy, weighted precision / recall / f1 and Cohen's kappa, one row per group."""
    t = _totals(class_scores(conf, by), by)
    kappa = F.try_divide(F.col("accuracy") - F.col("chance"), F.lit(1.0) - F.col("chance"))
    return t.select(*by, "balanced_accuracy", F.col("weighted precision").alias("precision"),
                    F.col("weighted recall").alias("recall"),
                    F.col("weighted f1-score").alias("f1-score"), kappa.alias("kappa"))


def long_metrics(wide: DataFrame, by: Sequence[str],
                 metrics: Sequence[str] = tuple(AVG_METRICS)) -> DataFrame:
    """Melt metric columns to (metric, value) rows."""
    return wide.select(*by, *[F.col(f"`{m}`").cast("double").alias(m) for m in metrics]).unpivot(
        list(by), list(metrics), "metric", "value")


def metrics_by_split(metrics: DataFrame, stage: str = "stage", split: str = "split") -> DataFrame:
    """metric x {Train, Validation, Test}, rounded to 4 digits."""
    wide = metrics.groupBy(stage, "metric").pivot(split, ["train", "val", "test"]).agg(F.max("value"))
    return wide.select(stage, "metric", *[rounded(c, 4).alias(n) for c, n in (
        ("train", "Train"), ("val", "Validation"), ("test", "Test"))])


def with_extra_rows(report: DataFrame, extra: DataFrame) -> DataFrame:
    """Append rows such as 'CV Score' or 'Execution Time'; columns they lack become null."""
    return report.unionByName(extra, allowMissingColumns=True)


def metrics_summary(metrics: DataFrame, stage: str = "stage", split: str = "split") -> DataFrame:
    """One row per stage with ``<metric>-<split>`` columns, rounded to 4 digits."""
    names = [f"{m}-{s}" for s in ("train", "val", "test") for m in AVG_METRICS]
    wide = (metrics.withColumn("_c", F.concat_ws("-", "metric", split))
                   .groupBy(F.col(stage).alias("Model")).pivot("_c", names).agg(F.max("value")))
    return wide.select("Model", *[rounded(n, 4).alias(n) for n in names])


def class_report_by_split(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Full outer join of the train, validation and test class reports on the class."""
    out = None
    for name in ("train", "val", "test"):
        part = scores.where(F.col("split") == name).select(
            *by, F.col("class").cast("string").alias("Class"),
            *[F.col(f"`{m}`").alias(f"{m}-{name}") for m in REPORT_METRICS])
        out = part if out is None else out.join(part, [*by, "Class"], "full")
    return out


def report_rows(nested: DataFrame, column: str, by: Sequence[str], suffix: str = "") -> DataFrame:
    """``map<class, struct>`` to one row per class, numbers rounded to 4, names suffixed."""
    flat = nested.select(*by, F.explode(column).alias("class", "r")).select(*by, "class", "r.*")
    return flat.select(*by, "class", *[
        rounded(c, 4).alias(f"{c}{suffix}") for c in flat.columns if c not in (*by, "class")])


def nested_report(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """One record per stage with the class report as ``map<class, struct>``."""
    entry = F.struct(F.col("class").cast("string").alias("key"), F.struct(
        *[F.col(f"`{m}`").cast("double").alias(m) for m in REPORT_METRICS]).alias("value"))
    return scores.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("report"))


def select_metrics(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Named metrics keyed by model: the numbers behind a heat map."""
    return summary.select("Model", *[F.col(f"`{m}`") for m in metrics])


def sort_models(summary: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    c = F.col(f"`{metric}`")
    return summary.orderBy(c.asc() if ascending else c.desc(), "Model")


def melt_metrics(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return summary.select("Model", *[F.col(f"`{m}`") for m in metrics]).unpivot(
        ["Model"], list(metrics), "Metric", "Score")


def trial_tally(trials: DataFrame) -> DataFrame:
    """Per stage: scored and failed trials, best score and its parameters."""
    return trials.groupBy("stage").agg(
        F.count_if(F.col("mean_score").isNotNull()).alias("successful"),
        F.count_if(F.col("mean_score").isNull()).alias("failed"),
        F.max("mean_score").alias("best_score"),
        F.max_by("params", F.struct("mean_score", -F.col("trial"))).alias("best_params"))


def mean_fold_score(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("score").alias("mean_score"))

