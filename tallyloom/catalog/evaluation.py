"""Evaluation tables, rankings and votes over the predictions of several stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.base import (
    CONF_CTE, METRICS_CTE, PREDS_CTE, SCORES_CTE, out, predictions, query, table,
)
from tallyloom.operators import ensemble, evaluate

BY = ["stage", "split"]
METRICS = evaluate.AVG_METRICS
SPLITS = ["train", "val", "test"]


def _conf(spark, sf):
    return evaluate.confusion(predictions(spark, sf), BY)


def _metrics(spark, sf):
    return evaluate.long_metrics(evaluate.average_metrics(_conf(spark, sf), BY), BY)


def _summary(spark, sf):
    return evaluate.metrics_summary(_metrics(spark, sf))


SUMMARY_CTE = METRICS_CTE + ", summary as (select stage as \"Model\", " + ", ".join(
    f"round(max(case when split = '{s}' and metric = '{m}' then value end), 4) as \"{m}-{s}\""
    for s in SPLITS for m in METRICS) + " from metrics group by stage)"


@query("q_h5_predictions", f"""with {PREDS_CTE} select row_id, stage, label, prediction, round(p0, 6) as p_first,
    round(p5, 6) as p_last from preds""")
def h5(spark, sf):
    return out(predictions(spark, sf).select(
        "row_id", "stage", "label", "prediction", F.get("probability", F.lit(0)).alias("p_first"),
        F.get("probability", F.lit(5)).alias("p_last")))


@query("q_h6_average_metrics", f"with {METRICS_CTE} select stage, split, "
       + ", ".join(f'round("{m}", 6) as "{m}"' for m in METRICS) + " from wide")
def h6(spark, sf):
    return out(evaluate.average_metrics(_conf(spark, sf), BY))


@query("q_h7_confusion_grid", f"""with {CONF_CTE}, l as (select distinct stage, split, label as c from conf
    union select distinct stage, split, prediction from conf)
    select a.stage, a.split, a.c as label, b.c as prediction, coalesce(conf.n, 0) as n from l a
    join l b on a.stage = b.stage and a.split = b.split left join conf on conf.stage = a.stage
      and conf.split = a.split and conf.label = a.c and conf.prediction = b.c""")
def h7(spark, sf):
    return evaluate.confusion_grid(_conf(spark, sf), BY)


@query("q_h8_classification_report", f"""with {METRICS_CTE} select stage, split, class::varchar as class,
    round(prec, 6) as "precision", round(rec, 6) as recall, round(f1, 6) as "f1-score", support from scores
    union all select stage, split, 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n::bigint from totals
    union all select stage, split, 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), n::bigint from totals
    union all select stage, split, 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), n::bigint from totals""")
def h8(spark, sf):
    return out(evaluate.classification_report(_conf(spark, sf), BY))


@query("q_j1_class_report_join", f"""with {SCORES_CTE}, parts as (select stage, split, class::varchar as cls, prec, rec, f1, support from scores)
    select stage, cls as "Class", """ + ", ".join(
        f"""round(max(case when split = '{s}' then {e} end), 6){'::bigint' if m == 'support' else ''} as \"{m}-{s}\""""
        for s in SPLITS for m, e in (("precision", "prec"), ("recall", "rec"), ("f1-score", "f1"),
                                     ("support", "support"))) + ' from parts group by stage, cls')
def j1(spark, sf):
    return out(evaluate.class_report_by_split(evaluate.class_scores(_conf(spark, sf), BY), ["stage"]))


@query("q_j2_lookup_counts", """with c as (select event_type as class, count(*) as n from events group by 1),
    d as (select *, row_number() over (order by class) - 1 as code from c)
    select event_id, code, n from events join d on events.event_type = d.class""")
def j2(spark, sf):
    from tallyloom.functions.scale import join_small
    from tallyloom.operators.profile import target_mapping
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("class"))
    codes = target_mapping(events, "class").select("class", "code", "n")
    return join_small(events, codes, ["class"]).select("event_id", "code", "n")


@query("q_t1_sort_by_metric", f"""with {SUMMARY_CTE} select "Model", "balanced_accuracy-test" from summary
    order by 2 desc, 1""")
def t1(spark, sf):
    return evaluate.sort_models(_summary(spark, sf), "balanced_accuracy-test").select(
        "Model", "balanced_accuracy-test")


@query("q_t2_sort_for_plot", f"""with {SUMMARY_CTE} select "Model", "kappa-val", "f1-score-val" from summary
    order by 2, 1""")
def t2(spark, sf):
    return evaluate.sort_models(_summary(spark, sf), "kappa-val", True).select(
        "Model", "kappa-val", "f1-score-val")


_VALUES = ["balanced_accuracy-test", "f1-score-test", "kappa-test"]


@query("q_t3_melt_metrics", f"with {SUMMARY_CTE}, s as (select \"Model\", "
       + ", ".join(f'"{v}"' for v in _VALUES) + " from summary) unpivot s on "
       + ", ".join(f'"{v}"' for v in _VALUES) + ' into name "Metric" value "Score"')
def t3(spark, sf):
    return evaluate.melt_metrics(_summary(spark, sf), _VALUES)


_RANKED = SUMMARY_CTE + """, b as (select *, split_part("Model", '_', 1) as family from summary
    where not starts_with("Model", 'Voting_')),
  f as (select *, row_number() over (partition by family order by "balanced_accuracy-val" desc, "Model") as r from b),
  ranked as (select "Model", row_number() over (order by "balanced_accuracy-val" desc, "Model") as rank
    from f where r = 1)"""


@query("q_w16_best_per_family", f'with {_RANKED} select * from ranked where rank <= 3')
def w16(spark, sf):
    return ensemble.select_best_models(_summary(spark, sf), 3)


@query("q_t4_top_models", f"""with {SUMMARY_CTE} select "Model", "f1-score-test" from summary
    order by 2 desc, 1 limit 4""")
def t4(spark, sf):
    return evaluate.sort_models(_summary(spark, sf), "f1-score-test").limit(4).select("Model", "f1-score-test")


_BY_SPLIT = """select stage, metric, round(max(case when split = 'train' then value end), 4) as "Train",
    round(max(case when split = 'val' then value end), 4) as "Validation",
    round(max(case when split = 'test' then value end), 4) as "Test" from metrics group by all"""


@query("q_t5_extra_rows", f"""with {METRICS_CTE}, r as ({_BY_SPLIT}),
    cv as (select stage, round(avg(s), 4) as "Train" from (select stage, user_id % 5 as fold,
      avg(case when label = prediction then 1.0 else 0.0 end) as s from preds where split = 'train'
      group by all) group by 1)
    select stage, metric, "Train", "Validation", "Test" from r
    union all select stage, 'CV Score', "Train", null, null from cv""")
def t5(spark, sf):
    """The average metrics with one more row per stage: the mean accuracy over five student folds."""
    report = evaluate.metrics_by_split(_metrics(spark, sf))
    folds = (predictions(spark, sf).where("split = 'train'")
             .groupBy("stage", (F.col("user_id") % 5).alias("fold"))
             .agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score")))
    extra = evaluate.mean_fold_score(folds, ["stage"]).select(
        "stage", F.lit("CV Score").alias("metric"), F.round("mean_score", 4).alias("Train"))
    return evaluate.with_extra_rows(report, extra)


@query("q_t6_metrics_by_split", f"with {METRICS_CTE} {_BY_SPLIT}")
def t6(spark, sf):
    return evaluate.metrics_by_split(_metrics(spark, sf))


@query("q_t7_metrics_summary", f"with {SUMMARY_CTE} select * from summary")
def t7(spark, sf):
    return _summary(spark, sf)


@query("q_t8_nested_report_rows", f"""with {SCORES_CTE} select stage, split, class::varchar as class,
    round(prec, 4) as "precision_test", round(rec, 4) as recall_test, round(f1, 4) as "f1-score_test",
    support::double as support_test from scores""")
def t8(spark, sf):
    nested = evaluate.nested_report(evaluate.class_scores(_conf(spark, sf), BY), BY)
    return evaluate.report_rows(nested, "report", BY, "_test")


@query("q_t11_distinct_values", "select distinct event_type from events")
def t11(spark, sf):
    return table(spark, sf, "events").select("event_type").distinct()


@query("q_t12_confusion_matrix", f"""with {CONF_CTE} select stage, split, label, """ + ", ".join(
    f"coalesce(sum(n) filter (prediction = {c}), 0)::bigint as pred_{c}" for c in range(6))
    + " from conf group by all")
def t12(spark, sf):
    return evaluate.confusion_matrix(_conf(spark, sf), list(range(6)), BY)


@query("q_p14_selected_metrics", f"""with {SUMMARY_CTE} select "Model", "balanced_accuracy-test",
    "kappa-test", "f1-score-train" from summary""")
def p14(spark, sf):
    return evaluate.select_metrics(_summary(spark, sf), ["balanced_accuracy-test", "kappa-test", "f1-score-train"])


# ---------------------------------------------------------------- votes

_NOT_VOTING = "not starts_with(stage, 'Voting_')"


@query("q_v1_chosen_members", f"""with {_RANKED} select "Model", rank from ranked where rank <= 3
    union all select unnest(['KNN_none', 'MLP_rfe']), unnest([101, 102])""")
def v1(spark, sf):
    """The automatic choice, then a manual one."""
    summary = _summary(spark, sf)
    auto = ensemble.choose_members(summary, 3)
    manual = ensemble.choose_members(summary, manual_selection=["KNN_none", "MLP_rfe"])
    ranks = {**{m: i + 1 for i, m in enumerate(auto)}, **{m: 101 + i for i, m in enumerate(manual)}}
    names = summary.where(F.col("Model").isin(list(ranks))).select("Model")
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col("Model")]
    return names.withColumn("rank", rank)


@query("q_v2_soft_vote", f"""with {PREDS_CTE}, m as (select row_id, """ + ", ".join(
    f"round(avg(p{c}), 12) as p{c}" for c in range(6)) + f""" from preds where {_NOT_VOTING} group by 1)
    select row_id, list_position([p0, p1, p2, p3, p4, p5], greatest(p0, p1, p2, p3, p4, p5)) - 1 as prediction,
    round(greatest(p0, p1, p2, p3, p4, p5), 6) as p from m""")
def v2(spark, sf):
    members = predictions(spark, sf).where(~F.col("stage").startswith("Voting_"))
    return out(ensemble.soft_vote(members, 6))


@query("q_v3_hard_vote", f"""with {PREDS_CTE}, c as (select row_id, prediction, count(*) as votes from preds
    where {_NOT_VOTING} group by all)
    select row_id, first(prediction order by votes desc, prediction) as prediction, max(votes) as votes
    from c group by 1""")
def v3(spark, sf):
    members = predictions(spark, sf).where(~F.col("stage").startswith("Voting_"))
    return ensemble.hard_vote(members)


@query("q_v5_ensembles_by_size", f"""with {_RANKED}, s as (select unnest([4, 5, 6, 7]) as size)
    select 'Voting_' || size as ensemble, size, "Model", rank from s join ranked on rank <= size""")
def v5(spark, sf):
    return ensemble.ensembles_by_size(_summary(spark, sf))


@query("q_v5_ensemble_metrics", f"""with {_RANKED}, s as (select unnest([4, 5, 6, 7]) as size),
    mem as (select 'Voting_' || size as ensemble, "Model" from s join ranked on rank <= size),
    c as (select ensemble, split, row_id, label, prediction, count(*) as votes from mem join preds
      on preds.stage = mem."Model" group by all),
    v as (select ensemble, split, row_id, any_value(label) as label,
      first(prediction order by votes desc, prediction) as prediction from c group by ensemble, split, row_id)
    select ensemble, split, round(avg(r), 6) as balanced_accuracy from (select ensemble, split, label,
      avg(case when label = prediction then 1.0 else 0.0 end) as r from v group by all) group by all""")
def v5_metrics(spark, sf):
    """Hard votes of every ensemble size, scored from one pass over the predictions."""
    members = ensemble.ensembles_by_size(_summary(spark, sf)).select("ensemble", F.col("Model").alias("stage"))
    rows = predictions(spark, sf).join(F.broadcast(members), "stage")       # 4 + 5 + 6 + 7 rows
    voted = ensemble.hard_vote(rows, "row_id", ["ensemble", "split", "label"])
    scores = evaluate.average_metrics(evaluate.confusion(voted, ["ensemble", "split"]), ["ensemble", "split"])
    return out(scores, "ensemble", "split", "balanced_accuracy")
