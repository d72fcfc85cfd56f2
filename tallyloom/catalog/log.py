"""Sources, projections, row features and sequence features over the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.base import log_cte, log_view, out, query, table
from tallyloom.functions.expr import rounded, safe_div
from tallyloom.functions.scale import new_path
from tallyloom.operators import clean, features, profile, windows
from tallyloom.sources.tables import (
    catalogue_text, load_data, load_matrix, read_catalogue,
)

KEYS = ["id_log", "aluno", "num_dia", "num_log"]


# ---------------------------------------------------------------- sources

@query("q_s1_delimited_scan", f"with {log_cte()} select id_log, aluno, num_dia, num_log, log_type, "
       "comportamento, ultimo_passo_correto, round(efetividade_passos_eq, 6) as efetividade_passos_eq, "
       "round(eq_DM_fator_diario, 6) as eq_DM_fator_diario from log")
def s1(spark, sf):
    path = new_path(spark, "log-text")
    df = log_view(spark, sf)
    df.write.option("sep", ";").option("header", True).csv(path)
    back = load_data(spark, path, df.schema, ";")
    return out(back, *KEYS, "log_type", "comportamento", "ultimo_passo_correto",
               "efetividade_passos_eq", "eq_DM_fator_diario")


@query("q_s2_catalogue_schema", f"""with {log_cte('id_log', 'num_log', 'log_type', 'comportamento',
       'tempo_passo', 'efetividade_passos_eq')},
    c as (select count(id_log) as id_log, count(num_log) as num_log, count(log_type) as log_type,
      count(comportamento) as comportamento, count(tempo_passo) as tempo_passo,
      count(efetividade_passos_eq) as efetividade_passos_eq from log),
    u as (unpivot c on id_log, num_log, log_type, comportamento, tempo_passo, efetividade_passos_eq
      into name name value n)
    select name, n, case when name in ('log_type', 'comportamento') then 'string'
      when name = 'efetividade_passos_eq' then 'double' else 'bigint' end as dtype from u""")
def s2(spark, sf):
    df = log_view(spark, sf, "id_log", "num_log", "log_type", "comportamento", "tempo_passo",
                  "efetividade_passos_eq")
    names, rows = new_path(spark, "catalogue"), new_path(spark, "log-text")
    spark.range(1).select(F.lit(catalogue_text(df)).alias("value")).coalesce(1).write.text(names)
    df.write.option("sep", ";").option("header", True).csv(rows)
    schema = read_catalogue(spark, names)
    back = load_data(spark, rows, schema, ";")
    cells = [F.struct(F.lit(f.name).alias("name"), F.count(f.name).alias("n"),
                      F.lit(f.dataType.simpleString()).alias("dtype")) for f in schema.fields]
    return back.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("r")).select("r.*")


@query("q_s3_feature_matrix", """select vec_id as row_id, label, len(embedding) as width,
    round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm
    from embeddings""")
def s3(spark, sf):
    from pyspark.ml.functions import vector_to_array
    m = load_matrix(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding", "label")
    x = vector_to_array("features")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b))
    return m.select("row_id", "label", F.size(x).alias("width"), rounded(norm, 5).alias("norm"))


# ---------------------------------------------------------------- projections and filters

@query("q_p1_remove_columns", f"with {log_cte('id_log', 'aluno', 'comportamento')} "
       "select id_log, comportamento from log")
def p1(spark, sf):
    df = log_view(spark, sf, "id_log", "aluno", "grupo", "log_type", "comportamento")
    return clean.remove_columns(df, ["aluno", "grupo", "log_type", "comportamento"], ["comportamento"])


@query("q_p3_remove_value", f"with {log_cte('id_log', 'comportamento')} "
       "select * from log where comportamento is distinct from '?'")
def p3(spark, sf):
    return clean.remove_instances_with_value(log_view(spark, sf, "id_log", "comportamento"),
                                             "comportamento", "?")


@query("q_p4_labelled_rows", f"with {log_cte('id_log', 'estado_afetivo')} "
       "select * from log where estado_afetivo is not null")
def p4(spark, sf):
    return clean.keep_labelled(log_view(spark, sf, "id_log", "estado_afetivo"), "estado_afetivo")


@query("q_p5_merge_labels", f"""with {log_cte('id_log', 'comportamento')} select id_log,
    case when comportamento in ('ON TASK', 'ON SYSTEM', 'ON TASK OUT', 'ON TASK CONVERSATION')
    then 'ON TASK' else comportamento end as comportamento from log""")
def p5(spark, sf):
    from tallyloom.plans.jobs import ON_TASK, ON_TASK_VALUES
    df = log_view(spark, sf, "id_log", "comportamento")
    return df.withColumn("comportamento", clean.merge_values("comportamento", ON_TASK_VALUES, ON_TASK))


@query("q_p6_merge_by_map", f"""with {log_cte('id_log', 'estado_afetivo')} select id_log,
    case estado_afetivo when 'BOREDOM' then 'NEGATIVE' when 'FRUSTRATION' then 'NEGATIVE'
    else estado_afetivo end as estado_afetivo from log""")
def p6(spark, sf):
    df = log_view(spark, sf, "id_log", "estado_afetivo")
    return df.withColumn("estado_afetivo", clean.merge_by_map(
        "estado_afetivo", {"BOREDOM": "NEGATIVE", "FRUSTRATION": "NEGATIVE"}))


@query("q_p7_columns_by_type", """select l_orderkey, l_partkey, l_suppkey, l_linenumber,
    round(l_quantity, 6) as l_quantity, round(l_extendedprice, 6) as l_extendedprice,
    round(l_discount, 6) as l_discount, round(l_tax, 6) as l_tax from lineitem""")
def p7(spark, sf):
    df = table(spark, sf, "lineitem")
    return out(df, *clean.columns_of_type(df, "number"))


@query("q_p8_columns_by_regex", """select round(l_quantity, 6) as l_quantity,
    l_returnflag, l_linestatus from lineitem""")
def p8(spark, sf):
    df = table(spark, sf, "lineitem")
    return out(df, *clean.columns_by_regex(df, "quant|flag$|status$"))


@query("q_p9_features_and_target", """select event_type as label, event_id,
    round(value, 6) as f0, user_id::double as f1 from events""")
def p9(spark, sf):
    from pyspark.ml.functions import vector_to_array
    df = table(spark, sf, "events").select("event_id", "value", "user_id", "event_type")
    v = clean.with_target(df, ["event_id", "value", "user_id"], "event_type")
    x = vector_to_array("features")
    return v.select("label", "event_id", rounded(F.get(x, F.lit(1))).alias("f0"),
                    F.get(x, F.lit(2)).alias("f1"))


@query("q_p10_sequence_key", f"with {log_cte('id_log', 'num_dia', 'num_log')} "
       "select id_log, num_dia * 1000 + num_log as sequence_id from log")
def p10(spark, sf):
    return log_view(spark, sf, "id_log", "num_dia", "num_log").select(
        "id_log", clean.sequence_key("num_dia", "num_log").alias("sequence_id"))


@query("q_p11_required_columns", f"""with {log_cte('aluno', 'log_type', 'comportamento', 'tempo_passo')}
    select 'aluno' as "column", count(*) - count(aluno) as n_null from log
    union all select 'log_type', count(*) - count(log_type) from log
    union all select 'comportamento', count(*) - count(comportamento) from log
    union all select 'tempo_passo', count(*) - count(tempo_passo) from log""")
def p11(spark, sf):
    df = log_view(spark, sf, "aluno", "log_type", "comportamento", "tempo_passo")
    clean.require_columns(df, ["aluno", "log_type"])
    return clean.null_counts(df, df.columns)


_P12 = ["id_log", "aluno", "comportamento", "num_click_acumulado", "num_click_passo",
        "num_passos_equacao", "eq_MM_fator_diario"]


@query("q_p12_clean_data", f"""with {log_cte(*_P12)} select id_log, comportamento, num_click_acumulado,
    num_click_passo, num_passos_equacao from log where comportamento is distinct from '?'""")
def p12(spark, sf):
    df = log_view(spark, sf, *_P12)
    # a copy of one counter up to scale: pruning must drop one of the pair
    df = df.withColumn("num_click_copy", F.col("num_click_acumulado") * 2)
    done = clean.clean_data(df, "comportamento", "?", ["aluno", "eq_MM_fator_diario"], ["id_log"],
                            handle_multicollinearity=True)
    name = "num_click_copy" if "num_click_copy" in done.columns else "num_click_acumulado"
    value = F.col(name) / 2 if name == "num_click_copy" else F.col(name)
    return done.select("id_log", "comportamento", value.cast("long").alias("num_click_acumulado"),
                       "num_click_passo", "num_passos_equacao")


@query("q_p13_preview", f"with {log_cte('id_log', 'aluno', 'log_type')} "
       "select * from log order by id_log limit 5")
def p13(spark, sf):
    return profile.preview(log_view(spark, sf, "id_log", "aluno", "log_type"), "id_log")


# ---------------------------------------------------------------- row features

def _feature_query(name, make, sql, *columns):
    """Register a row-feature query: ``sql`` lists the output expressions over the log."""

    @query(name, f"with {log_cte('id_log', *columns)} select id_log, {sql} from log")
    def run(spark, sf):
        made = make()
        made = made if isinstance(made, list) else [made]
        df = features.add_features(log_view(spark, sf, "id_log", *columns), made)
        return out(df, "id_log", *[f.name for f in made])
    return run


@query("q_f0_feature_template", f"""with {log_cte('id_log', 'num_click_passo', 'num_passos_equacao',
    'num_click_acumulado')} select id_log, num_click_acumulado, num_click_passo + num_passos_equacao as a,
    num_click_passo - num_click_acumulado as b from log""")
def f0(spark, sf):
    df = log_view(spark, sf, "id_log", "num_click_passo", "num_passos_equacao", "num_click_acumulado")
    return features.add_features(df, [
        features.Feature("a", ["num_click_passo", "num_passos_equacao"],
                         F.col("num_click_passo") + F.col("num_passos_equacao")),
        features.Feature("b", ["num_click_passo", "num_click_acumulado"],
                         F.col("num_click_passo") - F.col("num_click_acumulado"), consume=False)])


_feature_query("q_f1_relative_velocity", features.relative_velocity,
               "round(tempo_equacao / (tempo_medio_eq_diario + 1e-6::double), 6) as velocidade_relativa_equacao",
               "tempo_equacao", "tempo_medio_eq_diario")
_feature_query("q_f2_verified", features.verified,
               "verificado_com_mouse | verificado_com_teclado as verified",
               "verificado_com_mouse", "verificado_com_teclado")
_feature_query("q_f3_equation_accuracy", features.equation_accuracy,
               "round(num_passos_corretos_eq / (num_passos_equacao + 1), 6) as accuracy_eq",
               "num_passos_corretos_eq", "num_passos_equacao")
_feature_query("q_f4_click_ratio", features.click_ratio,
               "round(num_click_passo / (num_click_acumulado + 1), 6) as click_ratio",
               "num_click_passo", "num_click_acumulado")


def _plain(cols, name):
    return " + ".join(cols) + f" as {name}"


def _zero(cols, name):
    return "round(" + " + ".join(f"coalesce({c}, 0)" for c in cols) + f", 6) as {name}"


_feature_query("q_f5_operation_groups", features.operation_groups, ", ".join([
    _plain(features.BASIC_OPERATIONS, "basic_operations"),
    _plain(features.FRACTION_OPERATIONS, "fraction_operations"),
    _plain(features.ADVANCED_OPERATIONS, "advanced_operations")]),
    *features.BASIC_OPERATIONS, *features.FRACTION_OPERATIONS, *features.ADVANCED_OPERATIONS)
_feature_query("q_f6_clip_expert_sums", features.clip_expert_sums, ", ".join([
    _zero(features.CLIP_BASIC, "clip_basic_expert"),
    _zero(features.CLIP_ADVANCED, "clip_advanced_expert")]),
    *features.CLIP_BASIC, *features.CLIP_ADVANCED)
_feature_query("q_f7_daily_expert_sums", features.daily_expert_sums, ", ".join([
    _zero(features.DAILY_BASIC, "diario_basic_expert"),
    _zero(features.DAILY_ADVANCED, "diario_advanced_expert")]),
    *features.DAILY_BASIC, *features.DAILY_ADVANCED)
_feature_query("q_f8_total_expert_sums", features.total_expert_sums, ", ".join([
    _zero(features.TOTAL_BASIC, "total_basic_expert"),
    _zero(features.TOTAL_FRACTION, "total_fraction_expert"),
    _zero(features.TOTAL_ADVANCED, "total_advanced_expert")]),
    *features.TOTAL_BASIC, *features.TOTAL_FRACTION, *features.TOTAL_ADVANCED)
_FOCUS = ["type_window_gained_focus", "type_entered_window", "type_window_lost_focus", "type_left_window"]
_feature_query("q_f9_window_active", features.window_active, """case
    when type_window_lost_focus = 1 or type_left_window = 1 then 0
    when type_window_gained_focus = 1 or type_entered_window = 1 then 1 else 0 end as window_active""",
    *_FOCUS)


@query("q_f10_session_position", f"""with {log_cte(*KEYS)} select id_log, round(num_dia - 1
    + num_log / max(num_log) over (partition by num_dia), 6) as session_position from log""")
def f10(spark, sf):
    return out(features.session_position(log_view(spark, sf, *KEYS)), "id_log", "session_position")


_feature_query("q_f11_engagement_index", features.engagement_index,
               "round(tempo_equacao / (tempo_equacao + idle_time_acumulado + 1e-6::double), 6) as engagement_index",
               "tempo_equacao", "idle_time_acumulado")


@query("q_f12_class_delta", f"""with {log_cte('id_log', 'num_passos_corretos_eq', 'num_passos_equacao',
    'tempo_medio_eq_diario', 'tempo_medio_eq_diario_turma', 'media_efetividade_passos_eq_turma')}
    select id_log, round(tempo_medio_eq_diario - tempo_medio_eq_diario_turma, 6) as delta_tempo_eq,
    round(num_passos_corretos_eq / (num_passos_equacao + 1) - media_efetividade_passos_eq_turma, 6)
    as delta_accuracy from log""")
def f12(spark, sf):
    df = log_view(spark, sf, "id_log", "num_passos_corretos_eq", "num_passos_equacao",
                  "tempo_medio_eq_diario", "tempo_medio_eq_diario_turma",
                  "media_efetividade_passos_eq_turma")
    df = features.add_features(df, [features.equation_accuracy()])
    return out(features.add_features(df, features.class_performance_delta()),
               "id_log", "delta_tempo_eq", "delta_accuracy")


_feature_query("q_f13_time_efficiency", features.time_efficiency, """
    round(tempo_equacao / nullif(tempo_medio_eq_diario, 0), 6) as time_vs_mean,
    round(tempo_passo / nullif(tempo_medio_passo_diario, 0), 6) as step_efficiency,
    round(idle_time_acumulado / nullif(tempo_equacao, 0), 6) as relative_idle_time""",
    "tempo_equacao", "tempo_medio_eq_diario", "tempo_passo", "tempo_medio_passo_diario",
    "idle_time_acumulado")
_feature_query("q_f14_equation_progress", features.equation_progress, """
    round(num_passos_corretos_eq / nullif(num_passos_equacao, 0), 6) as progress_effectiveness,
    round(1 - efetividade_passos_eq, 6) as error_rate""",
    "num_passos_corretos_eq", "num_passos_equacao", "efetividade_passos_eq")
_feature_query("q_f15_step_verifications", features.step_verifications,
               "case when log_type = 'step_verification' then 1 else 0 end as step_verifications",
               "log_type")


@query("q_f16_clean_numeric", f"""with {log_cte('id_log', 'tempo_equacao', 'tempo_passo', 'log_type',
    'tempo_medio_eq_diario', 'num_click_acumulado')}, x as (select id_log::double as id_log, log_type,
    tempo_passo::double as tempo_passo, num_click_acumulado::double as num_click_acumulado,
    case when tempo_medio_eq_diario = 0 then null else tempo_equacao / tempo_medio_eq_diario end as ratio from log)
    select id_log, log_type, round(tempo_passo, 6) as tempo_passo,
    case when num_click_acumulado > 90 then 90.0 when num_click_acumulado < -90 then -90.0
      else num_click_acumulado end as num_click_acumulado,
    case when ratio > 90 then 90.0 else round(ratio, 6) end as ratio from (
      select id_log, log_type, case when tempo_passo > 90 then 90.0 else tempo_passo end as tempo_passo,
      num_click_acumulado, ratio from x)""")
def f16(spark, sf):
    df = log_view(spark, sf, "id_log", "tempo_equacao", "tempo_passo", "log_type",
                  "tempo_medio_eq_diario", "num_click_acumulado")
    inf = F.lit(float("inf"))
    ratio = F.when(F.col("tempo_medio_eq_diario") == 0, inf).otherwise(
        F.try_divide(F.col("tempo_equacao"), F.col("tempo_medio_eq_diario")))
    df = df.select("id_log", "log_type", "tempo_passo", "num_click_acumulado", ratio.alias("ratio"))
    done = features.clean_numeric(df, 90.0, keep=["id_log"])
    return out(done.withColumn("id_log", F.col("id_log").cast("double")))


@query("q_f17_safe_division", f"""with {log_cte('id_log', 'num_click_passo', 'num_passos_equacao')}
    select id_log, case when num_passos_equacao = 0 then -1.0
      else round(num_click_passo / num_passos_equacao, 6) end as by_column,
    round(num_click_passo / 4.0::double, 6) as by_scalar,
    0.0::double as by_zero from log""")
def f17(spark, sf):
    return out(log_view(spark, sf, "id_log", "num_click_passo", "num_passos_equacao").select(
        "id_log", safe_div("num_click_passo", "num_passos_equacao", -1.0).alias("by_column"),
        safe_div("num_click_passo", F.lit(4), 0).alias("by_scalar"),
        safe_div("num_click_passo", F.lit(0), 0).alias("by_zero")))


@query("q_f_all_behavior_features", f"""with {log_cte()} select id_log,
    round(tempo_equacao / (tempo_medio_eq_diario + 1e-6::double), 6) as velocidade_relativa_equacao,
    verificado_com_mouse | verificado_com_teclado as verified,
    {_plain(features.ADVANCED_OPERATIONS, 'advanced_operations')},
    {_zero(features.TOTAL_ADVANCED, 'total_advanced_expert')},
    round(num_dia - 1 + num_log / max(num_log) over (partition by num_dia), 6) as session_position
    from log""")
def f_all(spark, sf):
    return out(features.engineer_behavior(log_view(spark, sf)), "id_log", "velocidade_relativa_equacao",
               "verified", "advanced_operations", "total_advanced_expert", "session_position")


# ---------------------------------------------------------------- sequence features

W = "window w as (partition by aluno order by num_dia, num_log, id_log)"
_ORDER = "partition by aluno order by num_dia, num_log, id_log"


@query("q_w1_sequence_order", f"""with {log_cte(*KEYS)} select id_log, aluno, num_dia, num_log
    from log order by aluno, num_dia, num_log, id_log""")
def w1(spark, sf):
    return windows.sequence_order(log_view(spark, sf, *KEYS))


def _lags(source, prefix):
    return ", ".join(f"lag({source}, {i}) over w as {prefix}_{i}" for i in (1, 2, 3))


@query("q_w2_prev_step_correct", f"with {log_cte(*KEYS, 'ultimo_passo_correto')} select id_log, "
       f"{_lags('ultimo_passo_correto', 'prev_step_correct')} from log {W}")
def w2(spark, sf):
    df = windows.lag_features(log_view(spark, sf, *KEYS, "ultimo_passo_correto"),
                              {"ultimo_passo_correto": "prev_step_correct"})
    return df.select("id_log", *[f"prev_step_correct_{i}" for i in (1, 2, 3)])


@query("q_w3_prev_log_type", f"with {log_cte(*KEYS, 'log_type')} select id_log, "
       f"{_lags('log_type', 'prev_log_type')} from log {W}")
def w3(spark, sf):
    df = windows.lag_features(log_view(spark, sf, *KEYS, "log_type"), {"log_type": "prev_log_type"})
    return df.select("id_log", *[f"prev_log_type_{i}" for i in (1, 2, 3)])


@query("q_w4_prev_verification", f"with {log_cte(*KEYS, 'log_type')} select id_log, " + ", ".join(
    f"case when lag(log_type, {i}) over w = 'step_verification' then 1 else 0 end "
    f"as prev_eq_step_verification_{i}" for i in (1, 2, 3)) + f" from log {W}")
def w4(spark, sf):
    df = windows.lag_equals(log_view(spark, sf, *KEYS, "log_type"), "log_type", "step_verification",
                            "prev_eq_step_verification")
    return df.select("id_log", *[f"prev_eq_step_verification_{i}" for i in (1, 2, 3)])


def _rolling(source, name, kind):
    cast = "::bigint" if kind == "sum" else ""
    return ", ".join(
        f"case when count({source}) over ({_ORDER} rows between {k - 1} preceding and current row) = {k} "
        f"then round({kind}({source}) over ({_ORDER} rows between {k - 1} preceding and current row), 6){cast} "
        f"end as {name}_{k}" for k in (3, 5, 10))


def _rolling_query(qname, source, name, kind):
    @query(qname, f"with {log_cte(*KEYS, source)} select id_log, {_rolling(source, name, kind)} from log")
    def run(spark, sf):
        specs = [windows.Rolling(source, f"{name}_{k}", k, kind) for k in (3, 5, 10)]
        return out(windows.rolling_features(log_view(spark, sf, *KEYS, source), specs),
                   "id_log", *[s.name for s in specs])
    return run


_rolling_query("q_w5_success_rate", "ultimo_passo_correto", "success_rate", "avg")
_rolling_query("q_w6_avg_step_time", "tempo_passo", "avg_step_time", "avg")
_rolling_query("q_w7_idle_time_sum", "idle_time_acumulado", "idle_time_sum", "sum")
_rolling_query("q_w8_clicks_sum", "num_click_acumulado", "clicks_sum", "sum")


@query("q_w9_verification_rate", f"""with {log_cte(*KEYS, 'log_type')}, v as (select *,
    case when log_type = 'step_verification' then 1 else 0 end as s from log)
    select id_log, {_rolling('s', 'verification_rate', 'avg')} from v""")
def w9(spark, sf):
    df = features.add_features(log_view(spark, sf, *KEYS, "log_type"), [features.step_verifications()],
                               replace=False)
    specs = [windows.Rolling("step_verifications", f"verification_rate_{k}", k) for k in (3, 5, 10)]
    return out(windows.rolling_features(df, specs), "id_log", *[s.name for s in specs])


@query("q_w10_behavior_changed", f"""with {log_cte(*KEYS, 'comportamento')} select id_log,
    case when lag(comportamento) over w = comportamento then 0 else 1 end as behavior_changed
    from log {W}""")
def w10(spark, sf):
    df = windows.change_feature(log_view(spark, sf, *KEYS, "comportamento"), "comportamento",
                                "behavior_changed")
    return df.select("id_log", "behavior_changed")


@query("q_w11_between_verifications", f"""with {log_cte(*KEYS, 'log_type', 'tempo_passo')}, v as (
    select id_log, tempo_passo - lag(tempo_passo) over w as d from log
    where log_type = 'step_verification' {W})
    select log.id_log, v.d as time_between_verifications from log left join v on log.id_log = v.id_log""")
def w11(spark, sf):
    df = windows.marked_difference(log_view(spark, sf, *KEYS, "log_type", "tempo_passo"),
                                   F.col("log_type") == "step_verification", "tempo_passo",
                                   "time_between_verifications")
    return df.select("id_log", "time_between_verifications")


_DAY = "over (partition by aluno, num_dia)"


@query("q_w12_steps_in_equation", f"with {log_cte(*KEYS)} select id_log, count(num_log) {_DAY} "
       "as steps_in_equation from log")
def w12(spark, sf):
    return windows.day_progress(log_view(spark, sf, *KEYS)).select("id_log", "steps_in_equation")


@query("q_w13_step_position", f"with {log_cte(*KEYS)} select id_log, num_log - min(num_log) {_DAY} + 1 "
       "as step_position from log")
def w13(spark, sf):
    return windows.day_progress(log_view(spark, sf, *KEYS)).select("id_log", "step_position")


@query("q_w14_relative_position", f"with {log_cte(*KEYS)} select id_log, round((num_log - min(num_log) {_DAY}"
       f" + 1) / (count(num_log) {_DAY})::double, 6) as relative_position from log")
def w14(spark, sf):
    return out(windows.day_progress(log_view(spark, sf, *KEYS)), "id_log", "relative_position")


_TEMPORAL = [*KEYS, "log_type", "comportamento", "ultimo_passo_correto", "tempo_passo", "tempo_equacao",
             "tempo_medio_eq_diario", "tempo_medio_passo_diario", "idle_time_acumulado",
             "num_click_acumulado", "num_passos_corretos_eq", "num_passos_equacao",
             "efetividade_passos_eq"]


@query("q_w_all_temporal_features", f"""with {log_cte(*_TEMPORAL)}, v as (select *,
    case when log_type = 'step_verification' then 1 else 0 end as step_verifications from log)
    select id_log::double as id_log, lag(log_type, 2) over w as prev_log_type_2,
    {_rolling('ultimo_passo_correto', 'success_rate', 'avg')},
    {_rolling('step_verifications', 'verification_rate', 'avg')},
    case when lag(comportamento) over w = comportamento then 0 else 1 end::double as behavior_changed,
    round((num_log - min(num_log) {_DAY} + 1) / (count(num_log) {_DAY})::double, 6) as relative_position,
    round(tempo_passo / nullif(tempo_medio_passo_diario, 0), 6) as step_efficiency,
    round(1 - efetividade_passos_eq, 6) as error_rate from v {W}""")
def w_all(spark, sf):
    df = windows.temporal_features(log_view(spark, sf, *_TEMPORAL))
    return out(df, "id_log", "prev_log_type_2", *[f"{n}_{k}" for n in ("success_rate", "verification_rate")
                                                  for k in (3, 5, 10)],
               "behavior_changed", "relative_position", "step_efficiency", "error_rate")


def flagship(spark, sf):
    """Per event type: mean success rate, change rate and session position over the sequences."""
    df = log_view(spark, sf, *KEYS, "log_type", "comportamento", "ultimo_passo_correto")
    df = windows.rolling_features(df, [windows.Rolling("ultimo_passo_correto", "success_rate_5", 5)])
    df = windows.change_feature(df, "comportamento", "behavior_changed")
    df = features.session_position(windows.day_progress(df))
    return out(df.groupBy("log_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("success_rate_5").alias("mean_success_rate"),
        F.avg("behavior_changed").alias("change_rate"),
        F.avg("session_position").alias("mean_session_position"),
        F.avg("relative_position").alias("mean_relative_position")))


query("q_entry_class_summary", f"""with {log_cte(*KEYS, 'log_type', 'comportamento', 'ultimo_passo_correto')},
    x as (select log_type, case when count(ultimo_passo_correto) over ({_ORDER} rows between 4 preceding
      and current row) = 5 then avg(ultimo_passo_correto) over ({_ORDER} rows between 4 preceding and
      current row) end as s, case when lag(comportamento) over ({_ORDER}) = comportamento then 0 else 1 end as c,
      num_dia - 1 + num_log / max(num_log) over (partition by num_dia) as p,
      (num_log - min(num_log) {_DAY} + 1) / (count(num_log) {_DAY})::double as r from log)
    select log_type, count(*) as n, round(avg(s), 6) as mean_success_rate, round(avg(c), 6) as change_rate,
    round(avg(p), 6) as mean_session_position, round(avg(r), 6) as mean_relative_position
    from x group by log_type""")(flagship)
