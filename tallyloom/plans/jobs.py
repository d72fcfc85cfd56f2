"""Whole programs: load, clean, prepare, search stages, evaluate, vote, store.

Steps up to ``prepare`` are one lazy plan that ends in a stored frame (row_id, group, split, fold,
label, features); each later step reads that frame.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scale import bounded_rows, materialise
from tallyloom.operators.clean import (
    clean_data, keep_labelled, merge_by_map, merge_values, require_columns,
)
from tallyloom.operators.ensemble import VOTING_PREFIX, VotingModel, choose_members
from tallyloom.operators.evaluate import (
    average_metrics, class_scores, confusion, long_metrics, metrics_summary,
)
from tallyloom.operators.features import engineer_behavior
from tallyloom.operators.prep import (
    MAX_CATEGORIES, DataEncoder, DataImputer, LabelCodes, balance_data, column_kinds, to_vector,
)
from tallyloom.operators.profile import vector_distinct_counts
from tallyloom.operators.search import (
    SearchResult, SearchSettings, balanced, candidates, create_pipeline, run_search, score,
)
from tallyloom.operators.split import (
    split_by_groups_and_target, split_by_target, stratified_folds, whole_group_folds,
)
from tallyloom.sources import stores

# Label merges of the behaviour and emotion programs.
ON_TASK_VALUES = ["ON TASK", "ON SYSTEM", "ON TASK OUT", "ON TASK CONVERSATION"]
ON_TASK = "ON TASK"
UNDEFINED = "?"


@dataclass
class Settings:
    """Everything a program run can vary; defaults follow the documented programs."""
    target: str = "comportamento"
    key: str = "id_log"
    group: str | None = "aluno"
    models: Sequence[str] = ("Naive Bayes",)
    selectors: Sequence[str] = ("none",)
    search: str = "optuna"
    n_iter: int = 50
    folds: int = 10
    folds_by_group: bool = False
    test_size: float = 0.15
    val_size: float | None = 0.30
    columns_to_remove: Sequence[str] = ()
    columns_to_keep: Sequence[str] = ()
    handle_multicollinearity: bool = True
    categorical_threshold: int = 10  # numeric columns with fewer distinct values are one-hot encoded
    group_as_feature: bool = False   # let the models see the group id
    merge: dict = field(default_factory=dict)
    numerical_strategy: str = "knn"
    scaling: str = "none"
    balance: str | float | None = "auto"
    balance_first: bool = False      # oversample before cross-validation instead of inside folds
    use_voting: bool = False
    voting_folds: int = 5            # folds of an ensemble's cross-validated score; 0 leaves it out
    parallelism: int = 4
    trial_seconds: float | None = None  # longest run of one fold; beyond it its trial is cancelled and failed
    program: str = "base"
    spaces: dict = field(default_factory=dict)           # model -> space instead of the registry's
    selector_spaces: dict = field(default_factory=dict)
    seed: int = 42

    def search_settings(self) -> SearchSettings:
        return SearchSettings(folds=self.folds, parallelism=self.parallelism, seed=self.seed,
                              trial_seconds=self.trial_seconds,
                              balance=None if self.balance_first else self.balance)


@dataclass
class Prepared:
    data: DataFrame
    feature_names: list[str]
    classes: list


# ---------------------------------------------------------------- preparation

def clean_behavior(df: DataFrame, s: Settings) -> DataFrame:
    """Features first (they read columns that are dropped later), then cleaning and label merge."""
    out = engineer_behavior(df)
    out = clean_data(out, s.target, UNDEFINED, s.columns_to_remove,
                     [s.target, s.key, *([s.group] if s.group else []), *s.columns_to_keep],
                     s.handle_multicollinearity)
    out = keep_labelled(out, s.target)
    return out.withColumn(s.target, merge_values(s.target, ON_TASK_VALUES, ON_TASK))


def clean_emotion(df: DataFrame, s: Settings) -> DataFrame:
    """No feature engineering; rows without a label go first."""
    out = keep_labelled(df, s.target)
    out = clean_data(out, s.target, UNDEFINED, s.columns_to_remove,
                     [s.target, s.key, *([s.group] if s.group else []), *s.columns_to_keep],
                     s.handle_multicollinearity)
    return out.withColumn(s.target, merge_by_map(s.target, s.merge)) if s.merge else out


def prepare(df: DataFrame, s: Settings) -> Prepared:
    """Validate, code labels, split, impute and encode (both fitted on training rows), add folds."""
    df = materialise(df, "cleaned")        # read several times below
    require_columns(df, [s.target, *([s.group] if s.group else [])])
    codes = LabelCodes(s.target)
    coded = codes.fit_transform(df, "label").drop(s.target)
    split = (split_by_groups_and_target(coded, s.group, "label", s.test_size, s.val_size, s.seed)
             if s.group else split_by_target(coded, "label", s.key, s.test_size, s.val_size, s.seed))
    split = materialise(split, "split")
    if s.group and s.group_as_feature:
        split = split.withColumn(f"{s.group}_feature", F.col(s.group).cast("double"))
    fixed = [c for c in (s.key, s.group, "label", "split") if c]
    features = [c for c in split.columns if c not in fixed]
    train = split.where(F.col("split") == "train")
    imputer = DataImputer(s.numerical_strategy, key=s.key).fit(train.select(s.key, *features))
    rest = split.select(s.key, *[c for c in fixed if c != s.key])
    imputed = materialise(imputer.transform(split.select(s.key, *features)).join(rest, s.key), "imputed")
    train = imputed.where(F.col("split") == "train")
    kinds = column_kinds(train.select(*features), s.categorical_threshold)
    encoder = DataEncoder(kinds.numerical, kinds.nominal, scaling=s.scaling).fit(train)
    group = F.col(s.group) if s.group else F.lit(None).cast("long")
    if max(encoder.widths().values(), default=0) > MAX_CATEGORIES:     # too many for a column each; the values are the same
        encoded, names = encoder.sparse_vectors(imputed, s.key), encoder.sparse_columns()
    else:
        names = encoder.output_columns
        encoded = to_vector(encoder.transform(imputed), names)
    vectors = encoded.select(F.col(s.key).alias("row_id"), group.alias("group"), "split", "label", "features")
    return Prepared(add_folds(materialise(vectors, "vectors"), s), names, codes.classes)


def add_folds(vectors: DataFrame, s: Settings) -> DataFrame:
    """Folds 0..k-1 on the training rows, -1 elsewhere; stored."""
    train = vectors.where(F.col("split") == "train")
    folded = (whole_group_folds(train, "group", s.folds, s.seed) if s.folds_by_group and s.group
              else stratified_folds(train, "label", "row_id", s.folds, s.seed))
    rest = vectors.where(F.col("split") != "train").withColumn("fold", F.lit(-1))
    return materialise(folded.unionByName(rest), "prepared")


def prepare_digits(df: DataFrame, s: Settings) -> Prepared:
    """Matrix input: class-stratified split; columns with at least ``categorical_threshold``
    distinct training values are standardised, the others pass through."""
    split = materialise(split_by_target(df, "label", "row_id", s.test_size, s.val_size, s.seed), "split")
    train = split.where(F.col("split") == "train")
    counts = vector_distinct_counts(train, "features", s.categorical_threshold + 1)
    summary = train.agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("features")).alias("s")
                        ).select("s.count", "s.mean", "s.variance").first()
    n, mean = summary[0], summary["mean"].toArray()
    std = np.sqrt(summary["variance"].toArray() * (n - 1) / n)          # population deviation
    wide = np.array([counts[i] >= s.categorical_threshold for i in range(len(mean))])
    names = [f"px_{i}" for i in range(len(mean))]
    centre = F.array(*[F.lit(float(m)) for m in np.where(wide, mean, 0.0)])
    scale = F.array(*[F.lit(float(d)) for d in np.where(wide & (std > 0), std, 1.0)])
    scaled = F.zip_with(F.zip_with(vector_to_array("features"), centre, lambda a, b: a - b),
                        scale, lambda a, b: a / b)
    vectors = split.select("row_id", F.lit(None).cast("long").alias("group"), "split", "label",
                           array_to_vector(scaled).alias("features"))
    return Prepared(add_folds(materialise(vectors, "vectors"), s), names, sorted(
        r[0] for r in bounded_rows(split.select("label").distinct(), 10_000, "classes")))


# ---------------------------------------------------------------- stages

@dataclass
class StageResult:
    stage: str
    search: SearchResult | None
    metrics: DataFrame | None       # stage, split, metric, value
    seconds: float
    error: str | None = None
    cells: DataFrame | None = None  # stage, split, label, prediction, n


def stage_name(model: str, selector: str) -> str:
    return f"{model}_{selector}"


def stage_cells(model, data: DataFrame, stage: str, with_val: bool = False) -> DataFrame:
    """(stage, split, label, prediction, n) from one pass over all splits."""
    splits = ["train", "test", *(["val"] if with_val else [])]
    predicted = model.transform(data.where(F.col("split").isin(splits)))
    return confusion(predicted.withColumn("stage", F.lit(stage)), ["stage", "split"])


def cell_metrics(cells: DataFrame) -> DataFrame:
    return long_metrics(average_metrics(cells, ["stage", "split"]), ["stage", "split"])


def evaluate_model(model, data: DataFrame, stage: str, with_val: bool = False) -> DataFrame:
    """(stage, split, metric, value)."""
    return cell_metrics(stage_cells(model, data, stage, with_val))


def training_rows(prepared: Prepared, s: Settings) -> DataFrame:
    train = prepared.data.where(F.col("split") == "train")
    if not (s.balance_first and s.balance is not None):
        return train
    plain = train.select("row_id", "label", vector_to_array("features").alias("vec"))
    grown = balance_data(plain, "row_id", "vec", "label", s.balance, seed=s.seed)
    keyed = materialise(grown.select(
        F.coalesce(F.col("key").cast("string"), F.sha2(F.concat_ws(
            ",", F.col("label").cast("string"), F.transform("vec", lambda x: x.cast("string"))), 256)
        ).alias("row_id"), "label", array_to_vector("vec").alias("features")), "grown")
    return materialise(stratified_folds(keyed, "label", "row_id", s.folds, s.seed), "grown-folds")


def execute_stage(prepared: Prepared, train: DataFrame, model: str, selector: str,
                  s: Settings) -> StageResult:
    """Search, refit and evaluate one model x selector; an error becomes a failed stage."""
    stage, start = stage_name(model, selector), time.monotonic()
    try:
        found = candidates(model, selector, s.program, s.spaces.get(model), s.selector_spaces.get(selector))
        def make(params):
            return create_pipeline(model, selector, params, seed=s.seed)
        result = run_search(s.search, stage, train, make, found, s.n_iter, s.search_settings())
        if result.model is None:
            raise RuntimeError(f"no trial succeeded: {result.trials[0].error if result.trials else 'none run'}")
        cells = materialise(stage_cells(result.model, prepared.data, stage, s.use_voting), "cells")
        metrics = materialise(cell_metrics(cells), "metrics")
        return StageResult(stage, result, metrics, time.monotonic() - start, cells=cells)
    except Exception as e:          # noqa: BLE001 - other stages go on
        return StageResult(stage, None, None, time.monotonic() - start, f"{type(e).__name__}: {e}"[:500])


def pending_stages(spark: SparkSession, models: Sequence[str], selectors: Sequence[str],
                   completed: DataFrame | None = None) -> DataFrame:
    """(stage, model, selector) of the sweep minus the stages already in the metrics store."""
    rows = [(stage_name(m, x), m, x) for m in models for x in selectors]
    stages = spark.createDataFrame(rows or [("Naive Bayes_none", "Naive Bayes", "none")],
                                   "stage string, model string, selector string")
    if completed is None:
        return stages
    return stages.join(completed.select(F.col("stage")).distinct(), "stage", "left_anti")


@dataclass
class RunResult:
    metrics: DataFrame
    trials: DataFrame
    summary: DataFrame
    completed: list[str]
    failed: dict[str, str]
    models: dict


def _timestamp() -> str:
    return time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())


def save_stage(result: StageResult, prepared: Prepared, s: Settings, store: str) -> None:
    """Model, trials, class report and, last, the metrics record that marks the stage as done."""
    spark = prepared.data.sparkSession
    stores.save_model(result.search.model, store, result.stage, _timestamp(), spark)
    stores.save_trials(result.search.table(spark), f"{store}/trials")
    _save_report(result.cells, store)
    info = spark.createDataFrame(
        [(result.stage, s.search, float(result.search.best_score), float(result.seconds),
          {k: str(v) for k, v in result.search.best_params.items()}, [str(c) for c in prepared.classes],
          list(prepared.feature_names), json.dumps(result.search.best_params))],
        "stage string, training_type string, cv_score double, seconds double, "
        "hyperparameters map<string,string>, classes array<string>, features array<string>, parameters string")
    few = [t.coalesce(1) for t in (result.metrics, info, result.cells)]     # a stage's record holds them whole
    stores.save_metrics(stores.metric_records(*few), f"{store}/metrics")


def _save_report(cells: DataFrame, store: str) -> None:
    report = class_scores(cells, ["stage", "split"]).select(
        "split", "class", "precision", "recall", "f1-score", "support", "stage")
    stores.write_report(report, f"{store}/class-reports", by_stage=True)


def _stored(spark: SparkSession, store: str, done: DataFrame) -> tuple[DataFrame, DataFrame, dict, dict]:
    """(metrics, trials, models, parameters) of the finished stages."""
    names = materialise(done.select("stage").distinct(), "done")
    records = stores.load_all_metrics(spark, f"{store}/metrics").join(
        names.withColumnRenamed("stage", "stage_name"), "stage_name", "left_semi")
    trials = stores.load_trials(spark, f"{store}/trials").join(names, "stage", "left_semi")
    models = {r["stage"]: r["stage"] for r in bounded_rows(
        stores.latest_models(spark, store).join(names, "stage", "left_semi"), 10_000, "stages")}
    return stores.unpack_metrics(records), trials, models, stores.stored_parameters(records)


def execute_all_stages(prepared: Prepared, s: Settings, store: str | None = None,
                       done: DataFrame | None = None) -> RunResult:
    """Run every pending stage; each is stored before the next begins.

    ``done`` (a column ``stage``) names stages to skip; with a store their metrics, trials and
    models take part in the summary and in voting, so a run can be resumed after any stage, and a finished one
    returns its stored results. At most 10 000 stages, the models x selectors of the settings.
    """
    spark = prepared.data.sparkSession
    pending = bounded_rows(pending_stages(spark, s.models, s.selectors, done).orderBy("stage"),
                           10_000, "stages")
    metrics = trials = None
    models: dict = {}
    params: dict = {}
    if done is not None and store is not None and not done.isEmpty():
        metrics, trials, models, params = _stored(spark, store, done)
        metrics = metrics.where(~F.col("stage").startswith(VOTING_PREFIX))
        models = {m: stores.load_model(spark, store, m) for m in models if not m.startswith(VOTING_PREFIX)}
        metrics, trials = materialise(metrics, "stored"), materialise(trials, "stored")
    train = training_rows(prepared, s) if pending else None
    results = []
    for r in pending:
        result = execute_stage(prepared, train, r["model"], r["selector"], s)
        results.append(result)
        if result.error is not None:
            continue
        if store is not None:
            save_stage(result, prepared, s, store)
        table = result.search.table(spark)
        metrics = result.metrics if metrics is None else metrics.unionByName(result.metrics)
        trials = table if trials is None else trials.unionByName(table)
        models[result.stage] = result.search.model
        params[result.stage] = result.search.best_params
    if metrics is None:
        raise RuntimeError(f"all stages failed: {[(r.stage, r.error) for r in results]}")
    if s.use_voting:
        voted = evaluate_ensembles(prepared, models, metrics_summary(metrics), s, store=store, params=params)
        metrics = metrics.unionByName(voted)
    return RunResult(metrics, trials, metrics_summary(metrics), [r.stage for r in results if r.error is None],
                     {r.stage: r.error for r in results if r.error}, models)


def build_voting(models: dict, members: Sequence[str], voting: str, n_classes: int) -> VotingModel:
    return VotingModel([models[m] for m in members], voting, n_classes)


def ensemble_cv_score(prepared: Prepared, result_params: dict[str, dict], members: Sequence[str],
                      s: Settings, voting: str = "soft", k: int = 5) -> float:
    """Mean out-of-fold balanced accuracy of the vote: members are refitted on each k-1 folds, which are
    oversampled as the members' training rows were."""
    how = replace(s.search_settings(), balance=s.balance)
    train = stratified_folds(prepared.data.where(F.col("split") == "train").drop("fold"),
                             "label", "row_id", k, s.seed)
    train = materialise(train, "vote-folds")
    scores = []
    for f in range(k):
        rows = balanced(train.where(F.col("fold") != f), how)
        fitted = [create_pipeline(*m.split("_", 1), result_params[m], seed=s.seed).fit(rows) for m in members]
        vote = VotingModel(fitted, voting, len(prepared.classes))
        scores.append(score(vote.transform(train.where(F.col("fold") == f))))
    return sum(scores) / k


def evaluate_ensembles(prepared: Prepared, models: dict, summary: DataFrame, s: Settings,
                       sizes: Sequence[int] = (4, 5, 6, 7), metric: str = "balanced_accuracy-val",
                       voting: str = "soft", store: str | None = None, params: dict | None = None) -> DataFrame:
    """Metrics of one ensemble per size; a size beyond the number of model families takes all families.

    With ``s.voting_folds`` the vote of members whose parameters are known (run now, or stored) also gets a cross-validated score (split
    'train', metric 'CV Score'). With a store, every ensemble and its metrics are saved.
    """
    members = choose_members(summary, max(sizes), metric)
    spark, out, scores = prepared.data.sparkSession, None, {}
    for n in sizes:
        chosen, name = members[:n], f"{VOTING_PREFIX}{n}"
        vote = build_voting(models, chosen, voting, len(prepared.classes))
        cells = materialise(stage_cells(vote, prepared.data, name, True), "votes")
        one, cv = materialise(cell_metrics(cells), "votes"), None
        if s.voting_folds and all(m in (params or {}) for m in chosen):
            if tuple(chosen) not in scores:
                scores[tuple(chosen)] = ensemble_cv_score(prepared, params, chosen, s, voting, s.voting_folds)
            cv = scores[tuple(chosen)]
            one = one.unionByName(spark.createDataFrame([(name, "train", "CV Score", float(cv))], one.schema))
        if store is not None:
            stores.save_model(vote, store, name, _timestamp(), spark)
            _save_report(cells, store)
            info = spark.createDataFrame([(name, f"{voting} voting", cv, None, {"members": ", ".join(chosen)})],
                                         "stage string, training_type string, cv_score double, seconds double, "
                                         "hyperparameters map<string,string>")
            stores.save_metrics(stores.metric_records(one, info, cells), f"{store}/metrics")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- programs

def run_behavior(df: DataFrame, s: Settings = Settings(program="behavior"), store: str | None = None
                 ) -> RunResult:
    return execute_all_stages(prepare(clean_behavior(df, s), s), s, store)


def run_emotion(df: DataFrame, s: Settings | None = None, store: str | None = None) -> RunResult:
    s = s or Settings(target="estado_afetivo", columns_to_remove=["comportamento"])
    return execute_all_stages(prepare(clean_emotion(df, s), s), s, store)


def run_digits(df: DataFrame, s: Settings | None = None, store: str | None = None) -> RunResult:
    s = s or Settings(selectors=("none", "pca", "rf", "mi"), folds=5, group=None, test_size=0.2,
                      val_size=None)
    s = replace(s, balance=None, val_size=s.val_size or (0.25 if s.use_voting else None))
    return execute_all_stages(prepare_digits(df, s), s, store)
