import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tallyloom.functions.scale import materialise, new_path
from tallyloom.operators import ensemble, evaluate, search, selection
from tallyloom.operators.models import Classifier
from tallyloom.operators.split import split_by_target, stratified_folds
from tallyloom.plans import jobs
from tallyloom.sources import stores


@pytest.fixture(scope="module")
def blobs(spark):
    """Three separable classes in six columns, two of which say nothing."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(180):
        c = i % 3
        rows.append((i, c, [float(v) for v in np.r_[rng.normal(4 * c, 1, 2), rng.normal(-3 * c, 1, 2), rng.normal(0, 1, 2)]]))
    df = spark.createDataFrame(rows, "row_id long, label int, v array<double>").select(
        "row_id", "label", array_to_vector("v").alias("features"))
    return materialise(stratified_folds(split_by_target(df, "label", "row_id", 0.2, 0.1), "label", "row_id", 3))


SMALL = {"Logistic Regression": {"C": 1.0, "max_iter": 50, "class_weight": "balanced"},
         "Decision Tree": {"max_depth": 5}, "Random Forest": {"n_estimators": 10, "max_depth": 5},
         "Gradient Boosting": {"n_estimators": 3, "max_depth": 3}, "SVM": {"max_iter": 10, "class_weight": "balanced"},
         "KNN": {"n_neighbors": 3, "weights": "distance"},
         "XGBoost": {"n_estimators": 3, "max_depth": 3, "subsample": 0.9, "colsample_bytree": 0.8},
         "Naive Bayes": {"var_smoothing": 1e-4}, "MLP": {"hidden_layer_sizes": (8,), "max_iter": 60}}


@pytest.mark.parametrize("name", sorted(SMALL))
def test_models_learn(blobs, name):
    model = Classifier(name, SMALL[name]).fit(blobs.where("split = 'train'"))
    done = model.transform(blobs.where("split = 'test'"))
    assert search.score(done) > 0.8
    p = done.select(vector_to_array("probability").alias("p")).collect()
    assert all(sum(r["p"]) == pytest.approx(1.0) and len(r["p"]) == 3 for r in p)


@pytest.mark.parametrize("name,params", [("mi", {"k": 4}), ("pca", {"n_components": 0.9}),
                                         ("rf", {"threshold": "mean", "trees": 10, "depth": 4}),
                                         ("rfe", {"min_features_to_select": 2, "step": 0.4, "k": 2, "trees": 5, "depth": 3})])
def test_selectors(blobs, name, params):
    model = selection.build_selector(name, params).fit(blobs)
    kept = selection.kept_features(model)
    assert model.transform(blobs).select(F.size(vector_to_array("selected"))).first()[0] == len(kept)
    if name in ("mi", "rf"):
        assert not set(kept) & {4, 5}


def test_spaces():
    assert search.space_values({"range": (1, 3), "type": "int"}) == [1, 2, 3]
    assert search.space_values((0.0, 1.0)) == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert search.space_values((2, 4)) == [2, 3, 4]
    assert search.space_values((1e-4, 1.0, "log-uniform")) == pytest.approx([1e-4, 1e-3, 1e-2, 1e-1, 1.0])
    assert search.space_values("x") == ["x"]
    assert len(search.expand([{"a": [1, 2]}, {"a": [3], "b": [4, 5]}])) == 4
    assert len(search.candidates("SVM")) == 3 and len(search.candidates("Naive Bayes", "mi")) == 21
    assert search.shuffled([{"a": i} for i in range(9)]) == search.shuffled([{"a": i} for i in range(9)][::-1])


def test_search_isolates_failures(blobs):
    def make(p):
        return search.create_pipeline("Naive Bayes", "mi", p)
    found = [{"selector__k": 4}, {"selector__k": "broken"}]
    r = search.search_grid("s", blobs.where("split='train'"), make, found, search.SearchSettings(folds=3))
    assert r.best_params == {"selector__k": 4} and r.trials[1].mean_score is None and r.trials[1].error
    tally = evaluate.trial_tally(r.table(blobs.sparkSession)).first()
    assert (tally["successful"], tally["failed"]) == (1, 1)


def test_adaptive_search_covers_small_spaces_once(blobs):
    found = search.candidates("Naive Bayes")
    r = search.search_adaptive("s", blobs, lambda p: search.create_pipeline("Naive Bayes", "none", p), found, 10, 2,
                               search.SearchSettings(folds=2), refit=False)
    assert sorted(t.params["classifier__var_smoothing"] for t in r.trials) == [1e-5, 1e-4, 1e-3]


def test_balanced_folds(blobs):
    s = search.SearchSettings(folds=2, balance="auto")
    uneven = blobs.where("label <> 2 or row_id % 2 = 0")
    r = search.search_grid("s", uneven, lambda p: search.create_pipeline("Naive Bayes", "none", p),
                           [{"classifier__var_smoothing": 1e-4}], s)
    assert r.best_score > 0.8 and r.model is not None


def test_class_absent_from_truth(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "label int, prediction int")
    cells = evaluate.confusion(df)
    assert evaluate.average_metrics(cells).first()["balanced_accuracy"] == pytest.approx(0.75)
    report = {r["class"]: r for r in evaluate.classification_report(cells).collect()}
    assert report["2"]["support"] == 0 and report["2"]["recall"] == 0.0
    assert report["macro avg"]["recall"] == pytest.approx(0.5)
    assert evaluate.confusion_grid(cells).count() == 9


def test_vote_ties_go_to_the_smaller_class(spark):
    df = spark.createDataFrame([(1, 2, [0.2, 0.4, 0.4]), (1, 1, [0.2, 0.4, 0.4])],
                               "row_id int, prediction int, probability array<double>")
    assert ensemble.hard_vote(df).first()["prediction"] == 1
    assert ensemble.soft_vote(df, 3).first()["prediction"] == 1


@pytest.mark.parametrize("voting", ["soft", "hard"])
def test_voting_model(blobs, voting):
    train = blobs.where("split = 'train'")
    members = [Classifier(n, SMALL[n]).fit(train) for n in ("Naive Bayes", "Decision Tree", "Logistic Regression")]
    done = ensemble.VotingModel(members, voting, 3).transform(blobs.where("split = 'test'"))
    assert search.score(done) > 0.8 and done.columns[:len(blobs.columns)] == blobs.columns
    with pytest.raises(ValueError):
        ensemble.VotingModel(members, "loud", 3)


def test_model_store_uses_exact_stage_names(spark, blobs):
    root = new_path(spark, "models")
    model = search.create_pipeline("Naive Bayes").fit(blobs)
    for stage, at in (("Voting_4", "2024-01-01 00:00:00"), ("Voting_4", "2024-01-02 00:00:00"),
                      ("Voting_45", "2024-01-03 00:00:00")):
        stores.save_model(model, root, stage, at, spark)
    found = {r["stage"]: r["path"] for r in stores.latest_models(spark, root).collect()}
    assert found["Voting_4"].endswith("20240102000000")
    again = stores.load_model(spark, root, "Voting_4")
    assert again.transform(blobs).select("prediction").exceptAll(model.transform(blobs).select("prediction")).isEmpty()
    with pytest.raises(ValueError):
        stores.load_model(spark, root, "nope")


def test_sweep_resumes_and_votes(spark, blobs):
    data = blobs.withColumn("group", F.lit(None).cast("long"))
    p = jobs.Prepared(data, [f"f{i}" for i in range(6)], [0, 1, 2])
    names = ["Naive Bayes", "Decision Tree", "Logistic Regression", "Random Forest"]
    s = jobs.Settings(models=names, folds=2, n_iter=1, search="grid", balance=None, use_voting=True,
                      spaces={n: SMALL[n] for n in names})
    root = new_path(spark, "sweep")
    r = jobs.execute_all_stages(p, s, root)
    assert r.failed == {} and sorted(r.completed) == sorted(f"{n}_none" for n in names)
    assert "Voting_4" in {x["Model"] for x in r.summary.collect()}
    done = stores.load_all_metrics(spark, f"{root}/metrics").select(F.col("stage_name").alias("stage"))
    left = jobs.pending_stages(spark, [*names, "MLP"], ["none"], done)
    assert [x["stage"] for x in left.collect()] == ["MLP_none"]


def test_an_interrupted_sweep_goes_on(spark, blobs, monkeypatch):
    """Stage 2 of 3 kills the run; the next run skips stage 1, votes with its stored model and is then finished."""
    p = jobs.Prepared(blobs.withColumn("group", F.lit(None).cast("long")), [f"f{i}" for i in range(6)], [0, 1, 2])
    names = ["Decision Tree", "KNN", "Naive Bayes"]
    s = jobs.Settings(models=names, folds=2, n_iter=1, search="grid", balance=None, use_voting=True, voting_folds=0,
                      spaces={n: SMALL[n] for n in names})
    root, real, ran = new_path(spark, "sweep"), jobs.execute_stage, []

    def dying(prepared, train, model, selector, settings):
        if model == "KNN" and not ran.count("KNN"):
            ran.append(model)
            raise KeyboardInterrupt
        ran.append(model)
        return real(prepared, train, model, selector, settings)

    monkeypatch.setattr(jobs, "execute_stage", dying)
    with pytest.raises(KeyboardInterrupt):
        jobs.execute_all_stages(p, s, root)

    def finished():
        return stores.load_all_metrics(spark, f"{root}/metrics").select(F.col("stage_name").alias("stage"))

    assert [r["stage"] for r in finished().collect()] == ["Decision Tree_none"]
    r = jobs.execute_all_stages(p, s, root, finished())
    assert ran == ["Decision Tree", "KNN", "KNN", "Naive Bayes"] and r.failed == {}
    stages = {f"{n}_none" for n in names} | {f"Voting_{n}" for n in (4, 5, 6, 7)}
    assert {x["Model"] for x in r.summary.collect()} == stages == {x["stage"] for x in finished().collect()}
    again = jobs.execute_all_stages(p, s, root, finished())
    assert again.completed == [] and {x["Model"] for x in again.summary.collect()} == stages
    assert {x["stage"] for x in stores.read_report(spark, f"{root}/class-reports", "split string, class string, "
            "precision double, recall double, f1 double, support long, stage string").collect()} == stages
    record = stores.load_metrics(spark, f"{root}/metrics", "KNN_none").first()
    assert record["hyperparameters"]["classifier__n_neighbors"] == "3" and len(record["features"]) == 6
    assert sum(c["n"] for c in record["confusion"]["test"]) == blobs.where("split = 'test'").count()


def test_saved_neighbours_and_votes_need_no_scratch(spark, blobs, tmp_path):
    train = blobs.where("split = 'train'")
    knn = search.create_pipeline("KNN", "none", {"classifier__n_neighbors": 3}).fit(train)
    vote = ensemble.VotingModel([knn, search.create_pipeline("Naive Bayes").fit(train)], "soft", 3)
    before = {r["row_id"]: r["prediction"] for r in vote.transform(blobs).collect()}
    stores.save_model(vote, str(tmp_path / "store"), "Voting_2", "2024-01-01 00:00:00", spark)
    knn.stages[-1].set(knn.stages[-1].path, str(tmp_path / "gone"))
    back = stores.load_model(spark, str(tmp_path / "store"), "Voting_2")
    assert isinstance(back, ensemble.VotingModel) and "gone" not in back.members[0].stages[-1].getOrDefault("path")
    assert {r["row_id"]: r["prediction"] for r in back.transform(blobs).collect()} == before


@pytest.mark.parametrize("balance", [None, "auto"])
def test_elimination_inside_a_search(blobs, balance):
    uneven = blobs.where("split = 'train' and (label <> 2 or row_id % 2 = 0)")
    found = [{"selector__min_features_to_select": 2, "selector__step": 0.5, "selector__trees": 4, "selector__depth": 3,
              "selector__k": 2}]
    r = search.run_search("grid", "s", uneven, lambda p: search.create_pipeline("Naive Bayes", "rfe", p), found, 1,
                          search.SearchSettings(folds=2, balance=balance))
    assert [t.error for t in r.trials] == [None] and r.best_score > 0.8 and r.model is not None


def test_equal_vectors_have_one_answer(spark):
    rows = [(i, i % 2, [1.0, 1.0]) for i in range(8)] + [(9, 0, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "row_id long, label int, v array<double>").select(
        "row_id", "label", array_to_vector("v").alias("features"))
    answers = {tuple(Classifier("KNN", {"n_neighbors": 3}).fit(df.repartition(n)).transform(df.limit(1))
                     .select(vector_to_array("probability").alias("p")).first()["p"]) for n in (1, 2, 5, 7)}
    assert len(answers) == 1


def test_parameters_without_effect_are_folded():
    assert len(search.candidates("Logistic Regression")) == 3 * 3 * 2
    assert len(search.candidates("MLP")) == 3 * 3 * 2
    assert not any("min_samples_split" in k for p in search.candidates("Random Forest") for k in p)


def test_failed_stage_is_reported(blobs):
    p = jobs.Prepared(blobs, [], [0, 1, 2])
    s = jobs.Settings(folds=2, search="grid", balance=None, spaces={"MLP": {"hidden_layer_sizes": ["wrong"]}})
    done = jobs.execute_stage(p, blobs, "MLP", "none", s)
    assert done.error and done.metrics is None


def test_digits_preparation(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, [float(rng.normal(3 * (i % 2), 2)), float(i % 3), 5.0]) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, label int, v array<double>").select(
        "row_id", "label", array_to_vector("v").alias("features"))
    s = jobs.Settings(group=None, folds=3, test_size=0.2, val_size=None)
    p = jobs.prepare_digits(df, s)
    x = {(r["split"]): 0 for r in p.data.select("split").distinct().collect()}
    assert set(x) == {"train", "test"}
    train = np.array([r[0].toArray() for r in p.data.where("split='train'").select("features").collect()])
    assert train[:, 0].mean() == pytest.approx(0, abs=1e-9) and train[:, 0].std() == pytest.approx(1)
    assert set(np.unique(train[:, 1])) == {0.0, 1.0, 2.0} and set(train[:, 2]) == {5.0}   # too few values: untouched


def test_programs_share_one_group_safe_split(spark):
    rows = [(i, i % 15, 1 + i % 4, i, ["ON TASK", "OFF TASK", "?", None][i % 4 if i % 8 else 3],
             None if i % 9 == 0 else float(i % 30), f"t{i % 3}") for i in range(600)]
    df = spark.createDataFrame(rows, "id_log long, aluno long, num_dia long, num_log long, "
                                     "estado_afetivo string, x double, kind string")
    s = jobs.Settings(target="estado_afetivo", folds=2, n_iter=1, search="grid", balance=None,
                      spaces={"Naive Bayes": {"var_smoothing": [1e-3]}}, numerical_strategy="mean")
    clean = jobs.clean_emotion(df, s)
    assert clean.where("estado_afetivo is null or estado_afetivo = '?'").isEmpty()
    p = jobs.prepare(clean, s)
    assert p.classes == ["OFF TASK", "ON TASK"]
    assert p.data.groupBy("group").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert p.data.where("split <> 'train' and fold <> -1").isEmpty()
    r = jobs.execute_all_stages(p, s)
    assert [x["Model"] for x in r.summary.collect()] == ["Naive Bayes_none"]


def test_cleaned_rows_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def labelled(i):
        seen.add(1)
        return "ab"[i % 2]
    rows = spark.range(0, 80, 1, 2).select(F.col("id").alias("id_log"), (F.col("id") % 40).alias("aluno"),
                                           (F.col("id") % 13).cast("double").alias("x"), labelled("id").alias("comportamento"))
    made = jobs.prepare(rows, jobs.Settings(folds=2, numerical_strategy="mean"))
    assert made.data.count() == 80 and made.classes == ["a", "b"]
    assert seen.value == 80
