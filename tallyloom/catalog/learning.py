"""Stores, feature selection, classifiers, searches and programs.

Fits that SQL cannot state are checked by row counts here and by score and property tests.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.catalog.base import (
    FROM_PREDICTIONS, MATRIX_SPLIT, METRICS_CTE, PREDS_CTE, SCORES_CTE, log_cte, log_view, out, predictions, query, table,
)
from tallyloom.catalog.evaluation import BY, SUMMARY_CTE, _conf, _metrics, _summary
from tallyloom.functions.scale import materialise, new_path
from tallyloom.operators import evaluate, information, prep, profile, search, selection
from tallyloom.operators.models import Classifier, GaussianNB, naive_bayes_table
from tallyloom.operators.split import split_by_target, stratified_folds
from tallyloom.plans import jobs
from tallyloom.sources import stores
from tallyloom.sources.tables import load_matrix


def _matrix(spark, sf) -> DataFrame:
    return load_matrix(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding", "label")


def _prepared(spark, sf, folds: int = 3) -> jobs.Prepared:
    """Test and validation rows by class, folds on the training rows."""
    s = jobs.Settings(folds=folds, group=None)
    split = materialise(split_by_target(_matrix(spark, sf), "label", "row_id", 0.2, 0.1), "split")
    vectors = split.select("row_id", F.lit(None).cast("long").alias("group"), "split", "label", "features")
    return jobs.Prepared(jobs.add_folds(vectors, s), [f"px_{i}" for i in range(64)], list(range(10)))


# ---------------------------------------------------------------- stores

_INFO = """info as (select stage, avg(case when label = prediction then 1.0 else 0.0 end) as acc from preds
    where split = 'train' group by 1)"""


def _records(spark, sf) -> DataFrame:
    info = (predictions(spark, sf).where("split = 'train'").groupBy("stage")
            .agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("cv_score"))
            .select("stage", F.lit("grid").alias("training_type"), "cv_score", F.lit(1.0).alias("seconds")))
    return stores.metric_records(_metrics(spark, sf), info)


def _saved(spark, sf) -> str:
    path = new_path(spark, "metrics")
    stores.save_metrics(_records(spark, sf), path)
    return path


@query("q_s4_all_stage_metrics", f"""with {METRICS_CTE}, {_INFO} select wide.stage as stage_name,
    'grid' as training_type, round(acc, 6) as cv_score, """ + ", ".join(
        f'round("{m}", 6) as "{m}"' for m in evaluate.AVG_METRICS)
    + " from wide join info on wide.stage = info.stage where split = 'test'")
def s4(spark, sf):
    return out(stores.flat_metrics(stores.load_all_metrics(spark, _saved(spark, sf))))


@query("q_s5_one_stage_metrics", f"""with {METRICS_CTE} select stage, split, metric, round(value, 6) as value
    from metrics where stage = 'KNN_none'""")
def s5(spark, sf):
    return out(stores.unpack_metrics(stores.load_metrics(spark, _saved(spark, sf), "KNN_none")))


@query("q_s6_saved_metrics", f"with {METRICS_CTE} select stage, split, metric, round(value, 6) as value from metrics")
def s6(spark, sf):
    return out(stores.unpack_metrics(stores.load_all_metrics(spark, _saved(spark, sf))))


@query("q_s7_consolidated_report", f"with {SUMMARY_CTE} select * from summary")
def s7(spark, sf):
    path, summary = new_path(spark, "report"), _summary(spark, sf)
    stores.write_report(summary, path)
    return stores.read_report(spark, path, summary.schema)


@query("q_s8_stage_reports", f"""with {SCORES_CTE} select stage, split, class, round(prec, 6) as "precision",
    round(rec, 6) as recall, round(f1, 6) as "f1-score", support from scores""")
def s8(spark, sf):
    path = new_path(spark, "class-reports")
    report = out(evaluate.class_scores(_conf(spark, sf), BY), "split", "class", "precision", "recall",
                 "f1-score", "support", "stage")
    stores.write_report(report, path, by_stage=True)
    return stores.read_report(spark, path, report.schema)


@query("q_s6_report_json", f"""with {SCORES_CTE} select stage, split, class::varchar as class,
    round(prec, 4) as "precision", round(rec, 4) as recall, round(f1, 4) as "f1-score",
    support::double as support from scores""")
def s6_json(spark, sf):
    """Nested class reports through JSON text and back."""
    nested = evaluate.nested_report(evaluate.class_scores(_conf(spark, sf), BY), BY)
    back = stores.decode_report(stores.encode_report(nested))
    return evaluate.report_rows(back, "report", BY)


_TRIALS_SQL = f"""{PREDS_CTE}, f as (select stage, no, user_id % 5 as fold,
    avg(case when label = prediction then 1.0 else 0.0 end) as s from preds group by all),
  trials as (select stage, no as trial, case when no % 4 = 3 then null else avg(s) end as mean_score,
    list(round(s, 6) order by fold) as fold_scores from f group by stage, no)"""


def _trials(spark, sf) -> DataFrame:
    """One trial per stage: accuracies over five student folds; every fourth counts as failed."""
    folds = (predictions(spark, sf).groupBy("stage", "no", (F.col("user_id") % 5).alias("fold"))
             .agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score")))
    failed = F.col("trial") % 4 == 3
    return (folds.groupBy("stage", F.col("no").alias("trial"))
            .agg(F.sort_array(F.collect_list(F.struct("fold", "score"))).alias("f"), F.avg("score").alias("m"))
            .select("stage", "trial", F.create_map(F.lit("no"), F.col("trial").cast("string")).alias("params"),
                    F.transform("f", lambda x: F.round(x["score"], 6)).alias("fold_scores"),
                    F.when(~failed, F.col("m")).alias("mean_score"),
                    F.when(failed, "failed").otherwise("ok").alias("status"), F.lit(0.0).alias("seconds")))


def _stored_trials(spark, sf) -> DataFrame:
    path = new_path(spark, "trials")
    stores.save_trials(_trials(spark, sf), path)
    return stores.load_trials(spark, path)


@query("q_s9_trial_log", f"""with {_TRIALS_SQL} select stage, trial, round(mean_score, 6) as mean_score,
    case when mean_score is null then 'failed' else 'ok' end as status from trials""")
def s9(spark, sf):
    return out(_stored_trials(spark, sf), "stage", "trial", "mean_score", "status")


@query("q_s10_cv_results", f"""with {_TRIALS_SQL} select stage, trial, unnest(fold_scores) as score,
    unnest(range(0, 5)) as fold from trials""")
def s10(spark, sf):
    return out(_stored_trials(spark, sf).select("stage", "trial", F.posexplode("fold_scores").alias("fold", "score")))


@query("q_a23_trial_tally", f"""with {_TRIALS_SQL} select stage, count(mean_score) as successful,
    count(*) - count(mean_score) as failed, round(max(mean_score), 6) as best_score from trials group by 1""")
def a23(spark, sf):
    return out(evaluate.trial_tally(_trials(spark, sf)), "stage", "successful", "failed", "best_score")


@query("q_a24_mean_fold_score", f"""with {_TRIALS_SQL} select stage, trial, round(avg(u), 5) as mean_score
    from (select stage, trial, unnest(fold_scores) as u from trials) group by all""")
def a24(spark, sf):
    long = _trials(spark, sf).select("stage", "trial", F.explode("fold_scores").alias("score"))
    return out(evaluate.mean_fold_score(long, ["stage", "trial"]), digits=5)


@query("q_s11_mapping_tables", f"""with {log_cte('log_type')} select 'log_type' as feature,
    (row_number() over (order by log_type) - 1)::integer as code, log_type as value, count(*) as n,
    printf('%.2f%%', 100 * (count(*) / sum(count(*)) over ()::double)) as pct from log group by log_type""")
def s11(spark, sf):
    df = log_view(spark, sf, "log_type")
    report = profile.mapping_report(prep.dictionary(df, ["log_type"]), df)
    path = new_path(spark, "mapping")
    stores.write_report(report, path)
    return stores.read_report(spark, path, report.schema)


# ---------------------------------------------------------------- naive Bayes in SQL

_NB = """u as (select vec_id, label, unnest(embedding)::double as x, unnest(range(0, 64)) as j from embeddings),
  o as (select j, var_pop(x) as v from u group by 1),
  s as (select label as c, j, avg(x) as m, var_pop(x) + {smoothing}::double * (select max(v) from o) as v
    from u group by 1, 2),
  p as (select label as c, count(*) / (select count(*) from embeddings)::double as prior from embeddings group by 1),
  ll as (select vec_id, s.c, any_value(ln(prior)) - 0.5 * sum(ln(2 * pi() * s.v) + (x - m) * (x - m) / s.v) as score
    from u join s on u.j = s.j join p on p.c = s.c group by 1, 2),
  pr as (select vec_id, c, score, exp(score - max(score) over (partition by vec_id)) as e from ll),
  best as (select vec_id, first(c order by score desc, c) as prediction, max(e) / sum(e) as p from pr group by 1)"""


@query("q_m8_naive_bayes", f"""with {_NB.format(smoothing='1e-4')} select vec_id as row_id,
    prediction::double as prediction, round(p, 5) as p from best""")
def m8(spark, sf):
    df = _matrix(spark, sf)
    done = GaussianNB(1e-4).fit(df).transform(df)
    return out(done.select("row_id", "prediction",
                           F.array_max(vector_to_array("probability")).alias("p")), digits=5)


@query("q_m8_naive_bayes_table", f"""with {_NB.format(smoothing='1e-5')} select s.c as class, j as feature,
    round(prior, 6) as prior, round(m, 6) as mean, round(v, 6) as variance from s join p on s.c = p.c""")
def m8_table(spark, sf):
    return out(naive_bayes_table(_matrix(spark, sf), "features", "label", 1e-5), "class", "feature",
               "prior", "mean", "variance")


@query("q_s12_model_store", f"""with {_NB.format(smoothing='1e-4')} select vec_id as row_id,
    prediction::double as prediction from best""")
def s12(spark, sf):
    """Two models of one stage and one whose name extends it; the newest of the exact stage answers."""
    df, root = _matrix(spark, sf), new_path(spark, "model-store")
    for smoothing, stage, at in ((1.0, "Naive Bayes_none", "2024-01-01 10:00:00"),
                                 (1e-4, "Naive Bayes_none", "2024-01-02 10:00:00"),
                                 (5.0, "Naive Bayes_none_extra", "2024-01-03 10:00:00")):
        made = search.create_pipeline("Naive Bayes", "none", {"classifier__var_smoothing": smoothing})
        stores.save_model(made.fit(df), root, stage, at, spark)
    return stores.load_model(spark, root, "Naive Bayes_none").transform(df).select("row_id", "prediction")


# ---------------------------------------------------------------- feature selection

_MI = """u as (select label as y, unnest(embedding)::double as x, unnest(range(0, 64)) as feature from embeddings),
    r as (select feature, min(x) as lo, max(x) - min(x) as w from u group by 1),
    b as (select u.feature, y, least(floor((x - lo) * 10 / w), 9) as b from u join r on u.feature = r.feature),
    c as (select feature, b, y, count(*)::double as n from b group by all),
    m as (select *, sum(n) over (partition by feature, b) as nx, sum(n) over (partition by feature, y) as ny,
      sum(n) over (partition by feature) as t from c),
    mi as (select feature, sum(n / t * ln(n * t / (nx * ny))) as score from m group by 1)"""


@query("q_k1_mutual_information", f"with {_MI} select feature, round(score, 6) as score from mi")
def k1(spark, sf):
    return out(selection.mutual_information(_matrix(spark, sf)))


_DIGAMMA = """(ln({0} + 6.0) - 0.5 / ({0} + 6.0) - 1 / 12.0 / ({0} + 6.0) ** 2 + 1 / 120.0 / ({0} + 6.0) ** 4
    - 1 / 252.0 / ({0} + 6.0) ** 6 + 1 / 240.0 / ({0} + 6.0) ** 8
    - 1.0 / {0} - 1.0 / ({0} + 1) - 1.0 / ({0} + 2) - 1.0 / ({0} + 3) - 1.0 / ({0} + 4) - 1.0 / ({0} + 5))"""


@query("q_k1_neighbor_information", f"""with u as (select vec_id, label as y, unnest(embedding)::double as x,
      unnest(range(0, 64)) as feature from embeddings),
    d as (select a.feature, a.vec_id, a.y, a.x, abs(a.x - b.x) as d,
        row_number() over (partition by a.feature, a.vec_id order by abs(a.x - b.x)) as r
      from u a join u b on a.feature = b.feature and a.y = b.y and a.vec_id <> b.vec_id qualify r <= 3),
    e as (select feature, vec_id, y, x, max(d) as d from d group by all),
    c as (select e.feature, e.vec_id, e.y, count(*)::double as m, count(*) filter (u.y = e.y)::double as own
      from e join u on u.feature = e.feature and case when e.d > 0 then u.x > e.x - e.d and u.x < e.x + e.d else u.x = e.x end
      group by all),
    t as (select *, count(*) over (partition by feature, y)::double as ny, count(*) over (partition by feature)::double as n from c)
    select feature, round(greatest(avg({_DIGAMMA.format('n')} - {_DIGAMMA.format('ny')} + {_DIGAMMA.format('own')}
      - {_DIGAMMA.format('m')}), 0), 6) as score from t group by feature""")
def k1_neighbors(spark, sf):
    return out(information.neighbor_information(_matrix(spark, sf)))


@query("q_k1_quantile_information", """with u as (select label as y, unnest(embedding)::double as x, unnest(range(0, 64)) as feature
      from embeddings),
    q as (select feature, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from u group by 1),
    b as (select u.feature, y, len(list_filter(q, lambda e: e < x)) as b from u join q on u.feature = q.feature),
    c as (select feature, b, y, count(*)::double as n from b group by all),
    m as (select *, sum(n) over (partition by feature, b) as nx, sum(n) over (partition by feature, y) as ny,
      sum(n) over (partition by feature) as t from c)
    select feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) as score from m group by 1""")
def k1_quantiles(spark, sf):
    return out(information.quantile_information(_matrix(spark, sf)))


def _kept(spark, sf, selector: str, params: dict) -> DataFrame:
    df = materialise(stratified_folds(_matrix(spark, sf), "label", "row_id", 3), "rows")
    model = selection.build_selector(selector, params).fit(df)
    return selection.feature_info(f"Naive Bayes_{selector}", selector, model,
                                  [f"px_{i}" for i in range(64)], spark)


@query("q_k1_selected_features", f"""with {_MI} select 'Naive Bayes_mi' as stage, 'mi' as selector,
    64::integer as n_input, 10::integer as n_selected, 'px_' || feature as feature from mi
    order by score desc, mi.feature limit 10""")
def k1_top(spark, sf):
    return _kept(spark, sf, "mi", {"k": 10})


@query("q_k2_pca")
def k2(spark, sf):
    return _kept(spark, sf, "pca", {"n_components": 0.95})


@query("q_k2_facts", """with u as (select unnest(embedding)::double as x, unnest(range(0, 64)) as j from embeddings)
    select 64::integer as components, round(sum(v), 4) as trace, true as shares_fall, true as uncorrelated
    from (select j, var_samp(x) as v from u group by 1)""")
def k2_facts(spark, sf):
    """All components: their variances sum to the trace, fall, and the components are uncorrelated."""
    df = _matrix(spark, sf)
    model = selection.build_selector("pca", {"n_components": 64}).fit(df)
    y = model.transform(df).select(vector_to_array("selected").alias("y"))
    parts = y.select(F.posexplode("y").alias("i", "v")).groupBy("i").agg(F.var_samp("v").alias("v"))
    pairs = profile.correlation_pairs(y.select(*[F.col("y")[i].alias(f"c{i}") for i in range(64)]),
                                      [f"c{i}" for i in range(64)])
    flat = parts.agg(F.count(F.lit(1)).cast("int").alias("components"), F.round(F.sum("v"), 4).alias("trace"),
                     F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vs"))
    fall = F.forall(F.zip_with("vs", F.slice("vs", 2, 64), lambda a, b: F.coalesce(a >= b - 1e-9, F.lit(True))), lambda x: x)
    worst = pairs.agg(F.max(F.abs("r"))).first()[0]
    return flat.select("components", "trace", fall.alias("shares_fall"), F.lit(worst < 1e-5).alias("uncorrelated"))


@query("q_k3_forest_importances")
def k3(spark, sf):
    return _kept(spark, sf, "rf", {"threshold": "mean", "trees": 50, "depth": 6})


@query("q_k4_recursive_elimination")
def k4(spark, sf):
    return _kept(spark, sf, "rfe", {"min_features_to_select": 20, "step": 0.3, "k": 3, "trees": 10, "depth": 4})


@query("q_k6_feature_info")
def k6(spark, sf):
    made = selection.feature_info("Naive Bayes_none", "none", None, [f"px_{i}" for i in range(64)], spark)
    return made.unionByName(_kept(spark, sf, "pca", {"n_components": 10})).unionByName(
        _kept(spark, sf, "mi", {"k": 5}))


@query("q_k3_facts", """select 64::integer as features, true as sums_to_one, true as none_negative, true as keeps_those_from_mean
    from (select count(*) from embeddings)""")
def k3_facts(spark, sf):
    """Importances are shares, and the selector keeps exactly the features that reach their mean."""
    df = materialise(_matrix(spark, sf), "rows")
    imp = selection.forest_importances(df, trees=20, depth=5)
    kept = selection.kept_features(selection.build_selector("rf", {"threshold": "mean", "trees": 20, "depth": 5}).fit(df))
    shares = spark.createDataFrame([(i, float(v), i in kept) for i, v in enumerate(imp)], "i int, v double, kept boolean")
    mean = shares.agg(F.avg("v").alias("m"))
    return (shares.crossJoin(F.broadcast(mean)).agg(                       # one row of 64 features' mean
        F.count(F.lit(1)).cast("int").alias("features"), (F.abs(F.sum("v") - 1) < 1e-9).alias("sums_to_one"),
        F.bool_and(F.col("v") >= 0).alias("none_negative"),
        F.bool_and(F.col("kept") == (F.col("v") >= F.col("m") - 1e-15)).alias("keeps_those_from_mean")))


@query("q_k4_facts", """with k as (select min(n) as least from (select count(*) as n from embeddings group by label))
    select (row_number() over (order by width desc))::integer as step, width, least(3, least)::bigint as folds,
    true as scored from (select unnest([64, 45, 26, 20]) as width), k""")
def k4_facts(spark, sf):
    """Every width of the elimination is scored in every fold; the widest of the best is kept."""
    df = materialise(_matrix(spark, sf), "rows")
    made = selection.build_selector("rfe", {"min_features_to_select": 20, "step": 0.3, "k": 3, "trees": 5, "depth": 3})
    kept = selection.kept_features(made.fit(df))
    scores = spark.createDataFrame(made.scores, "fold int, width int, score double")
    per = scores.groupBy("width").agg(F.count(F.lit(1)).alias("folds"), F.avg("score").alias("m"),
                                      F.bool_and((F.col("score") >= 0) & (F.col("score") <= 1)).alias("scored"))
    best = per.agg(F.min_by("width", F.struct(-F.col("m"), "width")).alias("best"))
    steps = Window.orderBy(F.desc("width"))                                # one row per visited width
    return (per.crossJoin(F.broadcast(best)).select(
        F.row_number().over(steps).alias("step"), "width", "folds",
        (F.col("scored") & (F.col("best") == len(kept))).alias("scored")))


@query("q_k6_facts", """select * from (values ('none', 64::integer, 64::integer, 64::bigint), ('pca', 64, 10, 10), ('mi', 64, 5, 5))
    v(selector, n_input, n_selected, features)""")
def k6_facts(spark, sf):
    """The feature lists are as long as their counts say."""
    return k6(spark, sf).groupBy("selector", "n_input", "n_selected").agg(F.count_distinct("feature").alias("features"))


# ---------------------------------------------------------------- classifiers

def _model_query(name: str, model: str, params: dict, sql: str | None = None):
    @query(name, sql)
    def run(spark, sf):
        p = _prepared(spark, sf)
        fitted = Classifier(model, params).fit(p.data.where("split = 'train'"))
        return out(jobs.evaluate_model(fitted, p.data, f"{model}_none"))
    return run


_model_query("q_m1_logistic_regression", "Logistic Regression", {"C": 1.0, "max_iter": 100, "class_weight": "balanced"})
_model_query("q_m2_decision_tree", "Decision Tree", {"criterion": "entropy", "max_depth": 10, "min_samples_leaf": 2})
_model_query("q_m3_random_forest", "Random Forest", {"n_estimators": 50, "max_depth": 8, "class_weight": "balanced"})
_model_query("q_m4_gradient_boosting", "Gradient Boosting", {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3})
_model_query("q_m5_linear_svm", "SVM", {"C": 1.0, "class_weight": "balanced", "max_iter": 10})
_model_query("q_m6_knn_classifier", "KNN", {"n_neighbors": 7, "weights": "distance", "metric": "manhattan"},
             f"""with {MATRIX_SPLIT},
    d as (select q.vec_id, q.split, q.label as truth, t.label, t.vec_id as near, list_sum(list_transform(range(1, 65),
      lambda i: abs(q.embedding[i]::double - t.embedding[i]::double))) as d
      from sp q, sp t where q.split in ('train', 'test') and t.split = 'train'),
    k as (select *, row_number() over (partition by vec_id order by d, near) as r from d qualify r <= 7),
    z as (select *, min(d) over (partition by vec_id) = 0 as zero from k),
    v as (select vec_id, split, truth, label, sum(case when zero then (d = 0)::integer else 1 / d end) as w
      from z group by all),
    p as (select 'KNN_none' as stage, split, truth as label, first(label order by w desc, label) as prediction
      from v group by vec_id, split, truth),
    {FROM_PREDICTIONS} select stage, split, metric, round(value, 6) as value from metrics""")
_model_query("q_m7_boosted_trees", "XGBoost", {"n_estimators": 3, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.8})
_model_query("q_m9_perceptron", "MLP", {"hidden_layer_sizes": (50, 25), "max_iter": 100})


# What SQL can state of a fitted model: the rows it answered, that its probabilities sum to 1, and that it
# learned its training rows (the labels of the test rows are unrelated to the vectors).
_FACTS = f"""with {MATRIX_SPLIT} select split, label, count(*) as support, true as sums_to_one,
    case when split = 'train' then true end as beats_majority from sp where split in ('train', 'test') group by all"""


def _facts(name: str, model: str, params: dict):
    @query(name, _FACTS)
    def run(spark, sf):
        p = _prepared(spark, sf)
        fitted = Classifier(model, params).fit(p.data.where("split = 'train'"))
        done = fitted.transform(p.data.where("split in ('train', 'test')"))
        total = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, b: a + b)
        cells = done.groupBy("split", "label").agg(
            F.count(F.lit(1)).alias("support"), F.bool_and(F.abs(total - 1) < 1e-6).alias("sums_to_one"),
            F.count_if(F.col("label") == F.col("prediction")).alias("hits"))
        whole = cells.groupBy("split").agg(F.when(
            F.col("split") == "train", F.sum("hits") > F.max("support")).alias("beats_majority"))
        return cells.join(whole, "split").select("split", "label", "support", "sums_to_one", "beats_majority")
    return run


_facts("q_m1_facts", "Logistic Regression", {"C": 1.0, "max_iter": 100, "class_weight": "balanced"})
_facts("q_m2_facts", "Decision Tree", {"criterion": "entropy", "max_depth": 10, "min_samples_leaf": 2})
_facts("q_m3_facts", "Random Forest", {"n_estimators": 50, "max_depth": 8, "class_weight": "balanced"})
_facts("q_m4_facts", "Gradient Boosting", {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3})
_facts("q_m5_facts", "SVM", {"C": 1.0, "class_weight": "balanced", "max_iter": 10})
_facts("q_m7_facts", "XGBoost", {"n_estimators": 3, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.8})
_facts("q_m9_facts", "MLP", {"hidden_layer_sizes": (50, 25), "max_iter": 100})


# ---------------------------------------------------------------- search and stages

def _searched(spark, sf, kind: str, n_iter: int = 3) -> DataFrame:
    p = _prepared(spark, sf)
    train = p.data.where("split = 'train'")
    found = search.candidates("Naive Bayes", "pca", selector_space={"n_components": [0.8, 0.95]})
    result = search.run_search(kind, "Naive Bayes_pca", train, lambda q: search.create_pipeline(
        "Naive Bayes", "pca", q), found, n_iter, search.SearchSettings(folds=3))
    return result.table(spark).select("stage", "trial", "status", F.size("fold_scores").alias("folds"),
                                      F.col("mean_score").isNotNull().alias("scored"))


@query("q_h1_grid_search")
def h1(spark, sf):
    return _searched(spark, sf, "grid")


@query("q_h2_random_search")
def h2(spark, sf):
    return _searched(spark, sf, "random", 3)


@query("q_h3_adaptive_search")
def h3(spark, sf):
    return _searched(spark, sf, "optuna", 4)


def _search_facts(name: str, kind: str, n_iter: int, trials: int):
    @query(name, f"""with {MATRIX_SPLIT} select '{kind}' as kind, {trials}::bigint as trials, {trials}::bigint as distinct_sets,
      3::integer as folds, true as best_is_highest_mean, true as means_of_folds, count(*) as rows_refitted
      from sp where split = 'train'""")
    def run(spark, sf):
        """Distinct candidates, each scored on every fold; the best is the first of the highest mean."""
        p = _prepared(spark, sf)
        train = p.data.where("split = 'train'")
        found = search.candidates("Naive Bayes", "none", space={"var_smoothing": [1e-9, 1e-4, 1e-2, 1.0, 10.0]})
        result = search.run_search(kind, "Naive Bayes_none", train, lambda q: search.create_pipeline(
            "Naive Bayes", "none", q), found, n_iter, search.SearchSettings(folds=3))
        table = materialise(result.table(spark), "trials")
        answered = result.model.transform(train).where(F.col("prediction").isNotNull())
        mean = F.aggregate("fold_scores", F.lit(0.0), lambda a, b: a + b) / F.size("fold_scores")
        return table.agg(
            F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("trials"),
            F.count_distinct(F.array_sort(F.map_entries("params"))).alias("distinct_sets"),
            F.max(F.size("fold_scores")).alias("folds"),
            (F.abs(F.max("mean_score") - result.best_score) < 1e-12).alias("best_is_highest_mean"),
            F.bool_and(F.abs(mean - F.col("mean_score")) < 1e-12).alias("means_of_folds"),
            F.lit(answered.count()).alias("rows_refitted"))
    return run


_search_facts("q_h1_facts", "grid", 3, 5)                # every candidate, whatever n_iter says
_search_facts("q_h2_facts", "random", 3, 3)
_search_facts("q_h3_facts", "optuna", 4, 4)


_NB_SPLIT = f"""{MATRIX_SPLIT},
  u as (select vec_id, split, label, unnest(embedding)::double as x, unnest(range(0, 64)) as j from sp),
  t as (select * from u where split = 'train'),
  o as (select j, var_pop(x) as v from t group by 1),
  s as (select label as c, j, avg(x) as m, var_pop(x) + 1e-9::double * (select max(v) from o) as v from t group by 1, 2),
  pri as (select label as c, count(*) / (select count(*) from sp where split = 'train')::double as prior
    from sp where split = 'train' group by 1),
  ll as (select vec_id, split, label, s.c, any_value(ln(prior)) - 0.5 * sum(ln(2 * pi() * s.v) + (x - m) * (x - m) / s.v)
    as score from u join s on u.j = s.j join pri on pri.c = s.c group by all),
  p as (select 'Naive Bayes_none' as stage, split, label, first(c order by score desc, c) as prediction
    from ll group by vec_id, split, label)"""


@query("q_h9_evaluated_splits", f"""with {_NB_SPLIT}, {FROM_PREDICTIONS}
    select stage, split, metric, round(value, 6) as value from metrics""")
def h9(spark, sf):
    p = _prepared(spark, sf)
    model = search.create_pipeline("Naive Bayes").fit(p.data.where("split = 'train'"))
    return out(jobs.evaluate_model(model, p.data, "Naive Bayes_none", with_val=True))


@query("q_h5_model_probabilities", f"""with {_NB_SPLIT},
  e as (select *, exp(score - max(score) over (partition by vec_id)) as e from ll),
  pr as (select vec_id, split, label, c, e / sum(e) over (partition by vec_id) as p,
    first_value(c) over (partition by vec_id order by score desc, c) as best from e)
  select vec_id as row_id, split, label, c::integer as class, best::double as prediction, round(p, 5) as p from pr""")
def h5_model(spark, sf):
    """Prediction and the probability of every class, from the fitted naive Bayes stage."""
    p = _prepared(spark, sf)
    model = search.create_pipeline("Naive Bayes").fit(p.data.where("split = 'train'"))
    done = model.transform(p.data)
    return out(done.select("row_id", "split", "label", "prediction",
                           F.posexplode(vector_to_array("probability")).alias("class", "p")),
               "row_id", "split", "label", "class", "prediction", "p", digits=5)


_FAST = {"Naive Bayes": {"var_smoothing": [1e-4]}, "Decision Tree": {"max_depth": [5]},
         "Logistic Regression": {"C": [1.0], "max_iter": [30]},
         "Random Forest": {"n_estimators": [10], "max_depth": [5]}}


def _fast(**kw) -> jobs.Settings:
    base = dict(folds=2, n_iter=1, search="grid", group=None, balance=None, spaces=_FAST,
                handle_multicollinearity=False,
                selector_spaces={"pca": {"n_components": [0.9]}, "mi": {"k": [10]},
                                 "rf": {"threshold": ["mean"], "trees": [10], "depth": [4]}})
    return jobs.Settings(**{**base, **kw})


@query("q_h10_one_stage")
def h10(spark, sf):
    p = _prepared(spark, sf, 2)
    s = _fast(balance="auto")
    done = jobs.execute_stage(p, jobs.training_rows(p, s), "Naive Bayes", "none", s)
    return out(done.metrics)


@query("q_h11_sweep_with_resume")
def h11(spark, sf):
    """Two models x two selectors; the stage found in the metrics store is skipped."""
    p, s = _prepared(spark, sf, 2), _fast(models=["Naive Bayes", "Decision Tree"], selectors=["none", "mi"])
    root = new_path(spark, "sweep")
    jobs.execute_all_stages(p, _fast(models=["Naive Bayes"], selectors=["mi"]), root)
    done = stores.load_all_metrics(spark, f"{root}/metrics").select(F.col("stage_name").alias("stage"))
    result = jobs.execute_all_stages(p, s, root, done)
    ran = F.col("stage").isin(result.completed)
    return out(stores.unpack_metrics(stores.load_all_metrics(spark, f"{root}/metrics"))
               .withColumn("second_run", ran))


@query("q_h12_stage_pipeline")
def h12(spark, sf):
    p = _prepared(spark, sf)
    model = search.create_pipeline("Naive Bayes", "pca", {"selector__n_components": 0.9}).fit(
        p.data.where("split = 'train'"))
    done = model.transform(p.data.where("split = 'test'"))
    return done.select("row_id", "label", "prediction", F.size(vector_to_array("selected")).alias("width"))


@query("q_h12_facts", f"""with {MATRIX_SPLIT} select split, label, count(*) as support, 10::integer as width,
    true as same_as_by_hand from sp where split = 'test' group by all""")
def h12_facts(spark, sf):
    """The pipeline answers as its selector and classifier fitted one after the other."""
    p = _prepared(spark, sf)
    train, test = p.data.where("split = 'train'"), p.data.where("split = 'test'")
    whole = search.create_pipeline("Naive Bayes", "mi", {"selector__k": 10}).fit(train).transform(test)
    chosen = selection.build_selector("mi", {"k": 10}).fit(train)
    last = Classifier("Naive Bayes", {}, "selected").fit(chosen.transform(train))
    parts = last.transform(chosen.transform(test)).select("row_id", F.col("prediction").alias("by_hand"))
    return whole.join(parts, "row_id").groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("support"), F.max(F.size(vector_to_array("selected"))).alias("width"),
        F.bool_and(F.col("prediction") == F.col("by_hand")).alias("same_as_by_hand"))


@query("q_v4_facts", f"""with {MATRIX_SPLIT} select split, label, count(*) as support, true as is_mean_of_members
    from sp group by all""")
def v4_facts(spark, sf):
    """The refitted ensemble's probabilities are the means of its members'."""
    p = _prepared(spark, sf)
    train = p.data.where("split = 'train'")
    models = {m: search.create_pipeline(m.split("_")[0], "none", q).fit(train) for m, q in
              {"Naive Bayes_none": {"classifier__var_smoothing": 1e-4}, "Decision Tree_none": {"classifier__max_depth": 4},
               "Logistic Regression_none": {"classifier__C": 1.0, "classifier__max_iter": 20}}.items()}
    vote = jobs.build_voting(models, list(models), "soft", 10).transform(p.data).select(
        "row_id", "split", "label", "prediction", vector_to_array("probability").alias("vote"))
    for i, m in enumerate(models.values()):
        vote = vote.join(m.transform(p.data).select("row_id", vector_to_array("probability").alias(f"p{i}")), "row_id")
    mean = F.transform(F.arrays_zip("vote", "p0", "p1", "p2"),
                       lambda x: F.abs((x["p0"] + x["p1"] + x["p2"]) / 3 - x["vote"]) < 1e-9)
    top = F.get("vote", F.col("prediction").cast("int")) >= F.array_max("vote") - 1e-12
    return vote.groupBy("split", "label").agg(F.count(F.lit(1)).alias("support"),
                                              F.bool_and(F.forall(mean, lambda x: x) & top).alias("is_mean_of_members"))


@query("q_v4_ensemble_evaluated")
def v4(spark, sf):
    """Three members refitted, their soft vote evaluated, and its cross-validated score."""
    p = _prepared(spark, sf)
    params = {"Naive Bayes_none": {"classifier__var_smoothing": 1e-4},
              "Decision Tree_none": {"classifier__max_depth": 5},
              "Logistic Regression_none": {"classifier__C": 1.0, "classifier__max_iter": 30}}
    train = p.data.where("split = 'train'")
    models = {m: search.create_pipeline(*m.split("_", 1), q).fit(train) for m, q in params.items()}
    vote = jobs.build_voting(models, list(params), "soft", 10)
    cv = jobs.ensemble_cv_score(p, params, list(params), _fast(), k=2)
    done = evaluate.with_extra_rows(
        jobs.evaluate_model(vote, p.data, "Voting_3", True),
        spark.createDataFrame([("Voting_3", "train", "CV Score", cv)],
                              "stage string, split string, metric string, value double"))
    return out(done)


# ---------------------------------------------------------------- programs

_BEHAVIOR_DROPS = ["grupo", "estado_afetivo", "num_dia", "num_log"]


@query("q_q1_template_run")
def q1(spark, sf):
    """Load, clean, prepare, balance inside folds, search, evaluate, store, report."""
    root = new_path(spark, "run")
    s = _fast(group="aluno", target="comportamento", columns_to_remove=["grupo", "estado_afetivo"],
              numerical_strategy="median", balance="auto")
    result = jobs.execute_all_stages(jobs.prepare(jobs.clean_emotion(
        log_view(spark, sf, "id_log", "aluno", "grupo", "comportamento", "estado_afetivo", "tempo_passo",
                 "idle_time_acumulado", "num_click_passo", "log_type"), s), s), s, root)
    return result.summary


@query("q_q2_behavior_program")
def q2(spark, sf):
    s = _fast(group="aluno", program="behavior", columns_to_remove=_BEHAVIOR_DROPS, handle_multicollinearity=True)
    return jobs.run_behavior(log_view(spark, sf), s).summary


@query("q_q3_emotion_program")
def q3(spark, sf):
    s = _fast(group="aluno", target="estado_afetivo", columns_to_remove=["comportamento", "grupo", "num_dia", "num_log"],
              merge={"BOREDOM": "NEGATIVE", "FRUSTRATION": "NEGATIVE"}, numerical_strategy="mean")
    columns = ["id_log", "aluno", "grupo", "num_dia", "num_log", "comportamento", "estado_afetivo",
               "tempo_passo", "tempo_equacao", "idle_time_acumulado", "num_click_passo", "eq_SB", "log_type"]
    return jobs.run_emotion(log_view(spark, sf, *columns), s).summary


@query("q_q4_digits_program")
def q4(spark, sf):
    s = _fast(selectors=["none", "pca", "rf", "mi"], test_size=0.2, val_size=0.1)
    return jobs.run_digits(_matrix(spark, sf), s).summary
