"""Registry and the derived inputs the queries read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.profile import rounded_all

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def out(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return rounded_all(df.select(*columns) if columns else df, digits)


# ---------------------------------------------------------------- the log view of `events`
#
# The tutoring log is withheld, so its columns are derived from `events`: users are students, days
# of the month are sessions, seconds of the day number the log rows and the event property k feeds
# the counters. The expressions below mean the same in Spark SQL and in the oracle.

def _flag(condition: str, hole: str | None = None) -> str:
    body = f"cast(case when {condition} then 1 else 0 end as bigint)"
    return f"case when {hole} then null else {body} end" if hole else body


def _amount(modulus: int, step: float, hole: str | None = None) -> str:
    body = f"(k % {modulus}) * cast({step} as double)"
    return f"case when {hole} then null else {body} end" if hole else body


LOG_COLUMNS: dict[str, str] = {
    "id_log": "event_id",
    "aluno": "user_id",
    "grupo": "user_id % 5",
    "num_dia": "cast(dayofmonth(ts) as bigint)",
    "num_log": "cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) + 1 as bigint)",
    "log_type": "case when event_type = 'click' then 'step_verification' else event_type end",
    "comportamento": """case when k >= 95 then null when k >= 88 then '?'
        when event_type = 'click' then 'ON TASK' when event_type = 'view' then 'ON TASK OUT'
        when event_type = 'purchase' then 'ON TASK CONVERSATION'
        when event_type = 'signup' then 'OFF TASK' else 'ON SYSTEM' end""",
    "estado_afetivo": """case when k < 6 then null when k < 20 then '?'
        when event_type = 'click' then 'ENGAGED CONCENTRATION' when event_type = 'view' then 'CONFUSION'
        when event_type = 'purchase' then 'BOREDOM' else 'FRUSTRATION' end""",
    "ultimo_passo_correto": "case when k between 40 and 44 then null else cast(k % 2 as bigint) end",
    "tempo_passo": "case when k = 17 then null else cast(floor(value) as bigint) end",
    "tempo_equacao": "cast(floor(value * 2) as bigint)",
    "tempo_medio_eq_diario": _amount(20, 1.5),
    "tempo_medio_eq_diario_turma": _amount(7, 2.25),
    "tempo_medio_passo_diario": _amount(15, 0.5),
    "idle_time_acumulado": "case when k = 13 then null else cast(k % 30 as bigint) end",
    "num_click_acumulado": "cast(k as bigint)",
    "num_click_passo": "cast(k % 8 as bigint)",
    "num_passos_equacao": "cast(k % 12 as bigint)",
    "num_passos_corretos_eq": "cast(k % 5 as bigint)",
    "efetividade_passos_eq": "(k % 11) / cast(10 as double)",
    "media_efetividade_passos_eq_turma": "(k % 9) / cast(10 as double)",
    "verificado_com_mouse": _flag("event_type = 'click'", "k = 50"),
    "verificado_com_teclado": _flag("k % 3 = 0"),
    "type_window_gained_focus": _flag("k % 4 = 0"),
    "type_entered_window": _flag("k % 6 = 0", "k = 66"),
    "type_window_lost_focus": _flag("k % 10 = 0"),
    "type_left_window": _flag("k % 15 = 0", "k = 90"),
    "eq_AD": _flag("k % 2 = 0"), "eq_SB": _flag("k % 3 = 0", "k = 21"),
    "eq_MT": _flag("k % 5 = 0"), "eq_DV": _flag("k % 7 = 0"),
    "eq_AF": _flag("k % 11 = 0"), "eq_MF": _flag("k % 13 = 0", "k = 26"),
    "eq_DM": _flag("k % 17 = 0"), "eq_MM": _flag("k % 19 = 0"),
    "eq_OI": _flag("k % 23 = 0"), "eq_SP": _flag("k % 29 = 0", "k = 58"),
    "eq_MT_fator_clip": _amount(3, 0.5, "k = 9"),
    "eq_OI_fator_clip": _amount(4, 0.5),
    "misc_EqPrim_Ad_Sin_diario": _amount(5, 1.0),
    "misc_EqPrim_Dv_Sin_diario": _amount(6, 1.0, "k = 12"),
    "eq_SB_erro_diario": _amount(7, 1.0),
    "eq_MM_acerto_diario": _amount(8, 1.0),
    "eq_DM_erro_diario": _amount(9, 1.0, "k = 18"),
    "eq_DM_fator_diario": _amount(10, 0.25),
    "eq_MM_fator_diario": _amount(11, 0.25),
    "misc_OI_Dv_Plus_Dv_Minus_diario": _amount(12, 1.0),
    "misc_OI_Dv_Plus_Dv_Plus_diario": _amount(13, 1.0),
    "misc_OI_Dv_Minus_Dv_Plus_diario": _amount(14, 1.0),
    "misc_EqPrim_Ad_Inc_total": _amount(15, 1.0),
    "misc_EqPrim_Dv_Inc_total": _amount(16, 1.0, "k = 32"),
    "eq_AF_acerto_total": _amount(17, 1.0),
    "eq_AF_fator_total": _amount(18, 0.25),
    "eq_MF_fator_total": _amount(19, 0.25),
    "eq_DM_erro_total": _amount(20, 1.0),
    "eq_MM_fator_total": _amount(21, 0.25),
    "misc_OI_Dv_Plus_Dv_Minus_total": _amount(22, 1.0),
    "misc_OI_Mt_Minus_Ad_total": _amount(23, 1.0),
    "misc_OI_Dv_Plus_Dv_Plus_total": _amount(24, 1.0, "k = 24"),
    "misc_OI_Mt_Plus_Ad_total": _amount(25, 1.0),
    "misc_OI_Dv_Minus_Dv_Plus_total": _amount(26, 1.0),
    "misc_OI_Mt_Plus_Sb_total": _amount(27, 1.0),
    "misc_OI_Dv_Plus_Sb_total": _amount(28, 1.0),
}


def log_view(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.select(*[F.expr(LOG_COLUMNS[c]).alias(c) for c in columns or LOG_COLUMNS])


def log_cte(*columns: str) -> str:
    picked = ", ".join(f"{LOG_COLUMNS[c]} as {c}" for c in columns or LOG_COLUMNS)
    return (f"log as (select {picked} from (select *, "
            "cast(json_extract_string(props, '$.k') as integer) as k from events))")


# ---------------------------------------------------------------- predictions of several stages
#
# Ten stages predict the event type of every event; each is right up to its own bound on k and
# otherwise names a class by arithmetic. Class 5 is predicted but never a true label.

STAGES: dict[str, int] = {
    "Naive Bayes_none": 55, "Naive Bayes_pca": 60, "Random Forest_none": 70, "Random Forest_mi": 65,
    "KNN_none": 45, "Decision Tree_none": 50, "MLP_rfe": 40, "SVM_none": 62,
    "Logistic Regression_none": 58, "Voting_4": 80}
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

_LABEL = "case " + " ".join(f"when event_type = '{t}' then {i}" for i, t in enumerate(EVENT_TYPES)) + " end"
_SPLIT = "case when user_id % 10 < 6 then 'train' when user_id % 10 < 8 then 'val' else 'test' end"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    stages = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(b).alias("bound"), F.lit(i).alias("no"))
                                 for i, (s, b) in enumerate(STAGES.items())]))
    p = events.select(F.col("event_id").alias("row_id"), "user_id", "k", F.expr(_LABEL).alias("label"),
                      F.expr(_SPLIT).alias("split"), stages.alias("s")).select("*", "s.*").drop("s")
    raw = F.array(*[(1 + (F.col("k") * (c + 2) + F.col("no")) % 17).cast("double") for c in range(6)])
    total = F.aggregate("raw", F.lit(0.0), lambda a, b: a + b)
    return (p.withColumn("prediction", F.when(F.col("k") < F.col("bound"), F.col("label"))
                         .otherwise((F.col("k") + F.col("no")) % 6))
             .withColumn("raw", raw)
             .withColumn("probability", F.transform("raw", lambda x: x / total)).drop("raw", "bound"))


_STAGE_ROWS = ", ".join(f"('{s}', {b}, {i})" for i, (s, b) in enumerate(STAGES.items()))
_RAW = [f"(1 + (k * {c + 2} + no) % 17)" for c in range(6)]
PREDS_CTE = f"""preds as (select event_id as row_id, user_id, k, {_LABEL} as label, {_SPLIT} as split,
  stage, no, case when k < bound then {_LABEL} else (k + no) % 6 end as prediction,
  {', '.join(f'{r} / cast({" + ".join(_RAW)} as double) as p{c}' for c, r in enumerate(_RAW))}
  from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events)
  cross join (values {_STAGE_ROWS}) s(stage, bound, no))"""

CONF_CTE = PREDS_CTE + """, conf as (select stage, split, label, prediction, count(*) as n
  from preds group by all)"""

_SCORES = """, roles as (
  select stage, split, label as class, n as support, 0 as predicted,
         case when label = prediction then n else 0 end as tp from conf
  union all select stage, split, prediction, 0, n, 0 from conf),
counts as (select stage, split, class, sum(support)::bigint as support,
  sum(predicted)::bigint as predicted, sum(tp)::bigint as tp from roles group by all),
pr as (select *, case when predicted = 0 then 0.0 else tp / predicted::double end as prec,
  case when support = 0 then 0.0 else tp / support::double end as rec from counts),
scores as (select *, case when prec + rec = 0 then 0.0 else 2 * prec * rec / (prec + rec) end as f1
  from pr)"""

SCORES_CTE = CONF_CTE + _SCORES

_METRICS = """, totals as (select stage, split, sum(support)::double as n,
  sum(tp) / sum(support)::double as acc, avg(case when support > 0 then rec end) as bal,
  sum(prec * support) / sum(support) as wp, sum(rec * support) / sum(support) as wr,
  sum(f1 * support) / sum(support) as wf, avg(prec) as mp, avg(rec) as mr, avg(f1) as mf,
  sum(support::double * predicted) / (sum(support)::double * sum(support)) as pe
  from scores group by all),
wide as (select stage, split, bal as "balanced_accuracy", wf as "f1-score",
  (acc - pe) / nullif(1 - pe, 0) as "kappa", wp as "precision", wr as "recall" from totals),
metrics as (unpivot wide on "balanced_accuracy", "f1-score", "kappa", "precision", "recall"
  into name metric value value)"""

METRICS_CTE = SCORES_CTE + _METRICS

# the same metrics of any predictions `p` (stage, split, label, prediction)
FROM_PREDICTIONS = """conf as (select stage, split, label::integer as label, prediction::integer as prediction,
  count(*) as n from p group by all)""" + _SCORES + _METRICS

# `sp`: the embeddings with the class-stratified 70/10/20 split of the learning queries
MATRIX_SPLIT = """ranked as (select vec_id, label, embedding, count(*) over (partition by label) as size,
    row_number() over (partition by label order by md5(vec_id::varchar || '-42'), vec_id) as rank from embeddings),
  sp as (select vec_id, label, embedding, case when rank <= round(size * 0.2::double) then 'test'
    when rank <= round(size * 0.2::double) + round(size * 0.1::double) then 'val' else 'train' end as split from ranked)"""
