"""Trials that are cancelled, stages that crash, runs that are resumed."""

import time

import pytest
from pyspark.ml import Estimator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallyloom.operators.search import SearchSettings, cross_validate
from tallyloom.operators.models import Classifier
from tallyloom.plans import jobs
from tallyloom.sources import stores


class Odd(Estimator):
    """Fails on one fold, or runs a Spark job that takes a minute and a half."""

    def __init__(self, params):
        super().__init__()
        self.params_ = params

    def _fit(self, df):
        first = df.where("fold = 0").isEmpty()              # the fold left out is 0
        if self.params_["kind"] == "fails" and first:
            raise RuntimeError("bad fold")
        if self.params_["kind"] in ("fails", "slow"):
            def sleep(batches):
                import time
                for b in batches:
                    for _ in range(900):
                        time.sleep(0.1)
                    yield b
            df.select("row_id").repartition(1).mapInArrow(sleep, "row_id long").count()
        return Classifier("Naive Bayes").fit(df)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, Vectors.dense([float(i % 3), float(i % 2) + 0.1 * (i % 7)]), float(i % 2), i % 3) for i in range(60)]
    return spark.createDataFrame(data, ["row_id", "features", "label", "fold"]).cache()


def test_a_failing_fold_cancels_its_siblings_and_slow_trials_fail(spark, rows):
    cross_validate(rows, Odd, [{"kind": "fine"}], SearchSettings(folds=3))     # compiled code
    start = time.monotonic()
    found = [{"kind": "fails"}, {"kind": "fine"}, {"kind": "slow"}]
    trials = cross_validate(rows, Odd, found, SearchSettings(folds=3, parallelism=4, trial_seconds=25.0))
    assert time.monotonic() - start < 80
    assert "bad fold" in trials[0].error and trials[0].mean_score is None
    assert trials[1].error is None and trials[1].mean_score > 0.9
    assert "time limit" in trials[2].error and trials[2].mean_score is None
    assert not spark.sparkContext.getJobTags()


def prepared(spark):
    data = [(i, Vectors.dense([float(i % 3) + 0.01 * (i % 5), float(i % 2), 0.1 * (i % 7)]), i % 3 if i % 5 else 0, None,
             ["train", "train", "train", "val", "test"][i // 2 % 5]) for i in range(150)]
    df = spark.createDataFrame([(a, b, c, e) for a, b, c, _, e in data], ["row_id", "features", "label", "split"]).withColumn(
            "group", F.lit(None).cast("long")).withColumn("label", F.col("label").cast("int"))
    s = settings()
    return jobs.Prepared(jobs.add_folds(df, s), ["a", "b", "c"], [0, 1, 2])


def settings(**kw):
    return jobs.Settings(**{**dict(
        models=["Naive Bayes", "Decision Tree"], folds=2, n_iter=1, search="grid", group=None, balance=None, use_voting=True,
        voting_folds=2, spaces={"Naive Bayes": {"var_smoothing": [1e-3]}, "Decision Tree": {"max_depth": [3]}}), **kw})


def summary(result):
    return sorted(map(str, result.summary.collect()))


def test_a_crash_between_trials_and_metrics_changes_nothing(spark, tmp_path, monkeypatch):
    p, s = prepared(spark), settings()
    whole = jobs.execute_all_stages(p, s, f"{tmp_path}/whole")
    save, left = stores.save_metrics, [1]

    def crash(records, path):
        if left[0] and left.pop() and not left.append(0):
            raise OSError("disk gone")
        return save(records, path)
    monkeypatch.setattr(stores, "save_metrics", crash)
    root = f"{tmp_path}/crashed"
    with pytest.raises(OSError):
        jobs.execute_all_stages(p, s, root)
    again = jobs.execute_all_stages(p, s, root)
    assert summary(again) == summary(whole)
    trials = stores.load_trials(spark, f"{root}/trials")
    assert trials.count() == trials.select("stage", "trial").distinct().count() == 2


def test_the_vote_is_scored_on_balanced_folds(spark, monkeypatch):
    p, seen = prepared(spark), []
    monkeypatch.setattr(jobs, "balanced", lambda df, how: seen.append(how.balance) or df)
    jobs.ensemble_cv_score(p, {"Naive Bayes_none": {}}, ["Naive Bayes_none"], settings(balance="auto", balance_first=True), k=2)
    assert seen == ["auto", "auto"]


def test_a_resumed_run_equals_an_uninterrupted_one(spark, tmp_path):
    p, s = prepared(spark), settings()
    whole = jobs.execute_all_stages(p, s, f"{tmp_path}/whole")
    root = f"{tmp_path}/resumed"
    jobs.execute_all_stages(p, settings(models=["Naive Bayes"], voting_folds=0), root)
    done = stores.load_all_metrics(spark, f"{root}/metrics").select(F.col("stage_name").alias("stage"))
    again = jobs.execute_all_stages(p, s, root, done)
    assert summary(again) == summary(whole)
    scores = again.metrics.where("metric = 'CV Score'").count()
    assert scores == whole.metrics.where("metric = 'CV Score'").count() == 4
    params = stores.stored_parameters(stores.load_all_metrics(spark, f"{root}/metrics"))
    assert params["Decision Tree_none"] == {"classifier__max_depth": 3}
