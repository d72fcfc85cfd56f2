"""Splits, folds, preprocessing fits, neighbours and oversampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.catalog.base import log_cte, log_view, out, query, table
from tallyloom.functions.expr import rounded
from tallyloom.functions.scale import materialise
from tallyloom.operators import neighbors, prep, split


def _h(key: str, seed) -> str:
    return f"md5(concat({key}::varchar, '-{seed}'))"


def _u(name: str, seed) -> str:
    return f"(('0x' || substr({_h(name, seed)}, 1, 8))::bigint / 4294967296.0::double)"


# ---------------------------------------------------------------- splits

_GROUP_SPLIT = f"""g as (select aluno, row_number() over (order by {_h('aluno', 42)}, aluno) as r,
    count(*) over () as n from (select distinct aluno from log)),
  a as (select aluno, case when r <= round(n * 0.2) then 'test'
    when r <= round(n * 0.2) + round(n * 0.1) then 'val' else 'train' end as split from g)"""


@query("q_x1_split_by_groups", f"""with {log_cte('id_log', 'aluno')}, {_GROUP_SPLIT}
    select id_log, log.aluno, split from log join a on log.aluno = a.aluno""")
def x1(spark, sf):
    return split.split_by_groups(log_view(spark, sf, "id_log", "aluno"), "aluno", 0.2, 0.1).select(
        "id_log", "aluno", "split")


def _fold_cte(k: int) -> str:
    return f"""c as (select aluno, log_type, count(*) as n from log group by all),
  d as (select aluno, first(log_type order by n desc, log_type) as cls, sum(n)::bigint as size
    from c group by aluno),
  q as (select *, row_number() over (partition by cls order by size desc, {_h('aluno', 42)}, aluno) - 1 as q,
    dense_rank() over (order by cls) - 1 as turn from d),
  f as (select aluno, ((case when (q // {k}) % 2 = 0 then q % {k} else {k} - 1 - q % {k} end + turn)
    % {k})::integer as fold from q)"""


@query("q_x2_group_folds", f"with {log_cte('aluno', 'log_type')}, {_fold_cte(5)} select aluno, fold from f")
def x2_folds(spark, sf):
    return split.group_folds(log_view(spark, sf, "aluno", "log_type"), "aluno", "log_type", 5)


_X2 = _fold_cte(20) + """, a as (select aluno, case when fold < 3 then 'test' when fold < 9 then 'val'
    else 'train' end as split from f)"""


@query("q_x2_split_groups_target", f"""with {log_cte('id_log', 'aluno', 'log_type')}, {_X2}
    select id_log, log.aluno, log_type, split from log join a on log.aluno = a.aluno""")
def x2(spark, sf):
    df = log_view(spark, sf, "id_log", "aluno", "log_type")
    return split.split_by_groups_and_target(df, "aluno", "log_type", 0.15, 0.30).select(
        "id_log", "aluno", "log_type", "split")


_X3 = f"""r as (select *, row_number() over (partition by comportamento order by {_h('id_log', 42)}, id_log) as r,
    count(*) over (partition by comportamento) as n from log where comportamento is not null),
  s as (select * exclude (r, n), case when r <= round(n * 0.2) then 'test'
    when r <= round(n * 0.2) + round(n * 0.1) then 'val' else 'train' end as split from r)"""


@query("q_x3_split_by_target", f"with {log_cte('id_log', 'comportamento')}, {_X3} select * from s")
def x3(spark, sf):
    return split.split_by_target(log_view(spark, sf, "id_log", "comportamento"), "comportamento",
                                 "id_log", 0.2, 0.1).select("id_log", "comportamento", "split")


@query("q_x4_stratified_folds", f"""with {log_cte('id_log', 'comportamento')} select id_log, comportamento,
    ((row_number() over (partition by comportamento order by {_h('id_log', 42)}, id_log) - 1) % 10)::integer
    as fold from log where comportamento is not null""")
def x4(spark, sf):
    return split.stratified_folds(log_view(spark, sf, "id_log", "comportamento"), "comportamento",
                                  "id_log", 10).select("id_log", "comportamento", "fold")


@query("q_x4_group_folds", f"""with {log_cte('id_log', 'aluno')}, g as (select aluno, count(*) as size from log
    group by 1), q as (select aluno, row_number() over (order by size desc, {_h('aluno', 42)}, aluno) - 1 as q
    from g) select id_log, log.aluno, (case when (q // 5) % 2 = 0 then q % 5 else 4 - q % 5 end)::integer as fold
    from log join q on log.aluno = q.aluno""")
def x4_groups(spark, sf):
    return split.whole_group_folds(log_view(spark, sf, "id_log", "aluno"), "aluno", 5).select(
        "id_log", "aluno", "fold")


@query("q_x7_sample_fraction", f"""with {log_cte('id_log', 'log_type')}, r as (select *,
    row_number() over (order by {_h('id_log', 42)}, id_log) as r, count(*) over () as n from log)
    select id_log, log_type from r where r <= round(n * 0.3)""")
def x7(spark, sf):
    return split.sample_fraction(log_view(spark, sf, "id_log", "log_type"), "id_log", 0.3).select(
        "id_log", "log_type")


# ---------------------------------------------------------------- split checks

def _split_frame(spark, sf):
    """Rows split by day, so that students and classes fall as they may."""
    df = log_view(spark, sf, "id_log", "aluno", "num_dia", "log_type")
    return df.withColumn("split", F.expr(_BY_DAY))


_BY_DAY = "case when num_dia <= 18 then 'train' when num_dia <= 22 then 'val' else 'test' end"
_SPLIT_CTE = log_cte("id_log", "aluno", "num_dia", "log_type") + f", s as (select *, {_BY_DAY} as split from log)"
_SHARES = """d as (select log_type as class, count(*) filter (split = 'train') as a,
    count(*) filter (split = 'val') as b, count(*) filter (split = 'test') as c, count(*) as n
    from s group by 1),
  sh as (select class, a / sum(a) over ()::double as train, b / sum(b) over ()::double as val,
    c / sum(c) over ()::double as test, n / sum(n) over ()::double as whole, a, b, c from d)"""


@query("q_a11_split_distribution", f"""with {_SPLIT_CTE} select split, log_type as class, count(*) as n,
    round(count(*) / sum(count(*)) over (partition by split)::double, 6) as share from s group by 1, 2""")
def a11(spark, sf):
    return out(split.split_distribution(_split_frame(spark, sf), "log_type"))


@query("q_a11_group_overlaps", f"""with {_SPLIT_CTE}, p as (select aluno,
    max(case when split = 'train' then 1 else 0 end) as a, max(case when split = 'val' then 1 else 0 end) as b,
    max(case when split = 'test' then 1 else 0 end) as c from s group by 1)
    select unnest(['train', 'val', 'test', 'train&val', 'train&test', 'val&test']) as kind,
    unnest([sum(a), sum(b), sum(c), sum(a * b), sum(a * c), sum(b * c)])::bigint as n from p""")
def a11_groups(spark, sf):
    return split.group_overlaps(_split_frame(spark, sf), "aluno")


@query("q_a12_share_drift", f"""with {_SPLIT_CTE}, {_SHARES} select class, round(train, 6) as train,
    round(val, 6) as val, round(test, 6) as test, abs(train - val) >= 0.01 as val_flag,
    abs(train - test) >= 0.01 as test_flag from sh""")
def a12(spark, sf):
    return out(split.share_drift(_split_frame(spark, sf), "log_type", 0.01))


@query("q_a13_stratification_check", f"""with {_SPLIT_CTE}, {_SHARES} select
    round(max(abs(whole - train)), 6) as max_diff_train, round(max(abs(whole - val)), 6) as max_diff_val,
    round(max(abs(whole - test)), 6) as max_diff_test, sum(a)::bigint as n_train, sum(b)::bigint as n_val,
    sum(c)::bigint as n_test, max(abs(whole - train)) > 0.05 or max(abs(whole - test)) > 0.05 as alert
    from sh""")
def a13(spark, sf):
    return out(split.stratification_check(_split_frame(spark, sf), "log_type"))


@query("q_a14_split_report", f"""with {_SPLIT_CTE}, p as (select aluno,
    max(case when split = 'train' then 1 else 0 end) as a, max(case when split = 'val' then 1 else 0 end) as b,
    max(case when split = 'test' then 1 else 0 end) as c from s group by 1)
    select 'share:' || split || ':' || log_type as item,
      round(count(*) / sum(count(*)) over (partition by split)::double, 6) as value from s group by split, log_type
    union all select 'overlap:train&val', sum(a * b)::double from p
    union all select 'overlap:train&test', sum(a * c)::double from p
    union all select 'overlap:val&test', sum(b * c)::double from p""")
def a14(spark, sf):
    return out(split.split_report(_split_frame(spark, sf), "log_type", "aluno"))


@query("q_j5_groups_in_both", f"""with {_SPLIT_CTE} select distinct aluno from s where split = 'train'
    and aluno in (select aluno from s where split = 'test')""")
def j5(spark, sf):
    df = _split_frame(spark, sf)
    return (df.where("split = 'train'").select("aluno").distinct()
            .join(df.where("split = 'test'").select("aluno"), "aluno", "left_semi"))


@query("q_t9_group_intersection", f"""with {_SPLIT_CTE} select aluno from s where split = 'val'
    intersect select aluno from s where split = 'test'""")
def t9(spark, sf):
    return split.shared_groups(_split_frame(spark, sf), "aluno", "val", "test")


@query("q_t9_group_difference", """select distinct o_custkey from orders where o_orderstatus = 'F'
    and o_custkey not in (select o_custkey from orders where o_orderstatus = 'P')""")
def t9_minus(spark, sf):
    """Customers with finished but without pending orders."""
    return split.groups_only_in(table(spark, sf, "orders"), "o_custkey", "F", "P", "o_orderstatus")


# ---------------------------------------------------------------- preprocessing fits

_KINDS = ["aluno", "num_dia", "log_type", "tempo_equacao", "verificado_com_teclado", "eq_MT_fator_clip",
          "num_passos_corretos_eq", "eq_OI_fator_clip"]


def _kinds_frame(spark, sf):
    return log_view(spark, sf, *_KINDS).withColumn("nivel_ordinal", F.col("num_passos_corretos_eq"))


_KIND_COUNTS = "d as (" + " union all ".join(
    f"select '{c}' as feature, count(distinct {c}) as n, {str(c == 'log_type').lower()} as text from log"
    for c in _KINDS) + """ union all select 'nivel_ordinal', count(distinct num_passos_corretos_eq), false
    from log)"""


@query("q_e1_numerical_columns", f"with {log_cte(*_KINDS)}, {_KIND_COUNTS} "
       "select feature from d where n >= 5 and not text")
def e1(spark, sf):
    kinds = prep.kinds_table(_kinds_frame(spark, sf), 5)
    return kinds.where("kind = 'numerical'").select("feature")


@query("q_e2_nominal_columns", f"with {log_cte(*_KINDS)}, {_KIND_COUNTS} "
       "select feature from d where n < 5 or text")
def e2(spark, sf):
    kinds = prep.kinds_table(_kinds_frame(spark, sf), 5)
    return kinds.where("kind = 'nominal'").select("feature")


@query("q_e3_ordinal_columns", f"""with {log_cte('id_log', *_KINDS)}, {_KIND_COUNTS},
    o as (select feature from d where feature like '%ordinal%' and n <= 5),
    v as (select num_passos_corretos_eq as value, min(id_log) as first_key from log group by 1)
    select feature, value, first_key, row_number() over (order by first_key) - 1 as code from o, v""")
def e3(spark, sf):
    kinds = prep.column_kinds(_kinds_frame(spark, sf), 5)
    base = log_view(spark, sf, "id_log", "num_passos_corretos_eq").withColumnRenamed(
        "num_passos_corretos_eq", "nivel_ordinal")
    made = None
    for c in kinds.ordinal:
        one = prep.first_appearance(base, c, "id_log").withColumn("feature", F.lit(c))
        made = one if made is None else made.unionByName(one)
    return made.select("feature", "value", "first_key", "code")


_HOLES = ["ultimo_passo_correto", "tempo_passo", "idle_time_acumulado"]
_E4_CTE = log_cte("id_log", *_HOLES) + """, x as (select id_log as key, ultimo_passo_correto::double as a,
    tempo_passo::double as b, idle_time_acumulado::double as c from log),
  q as (select *, 0 as target from x where a is null union all select *, 1 from x where b is null
    union all select *, 2 from x where c is null),
  d as (select q.key as q_key, q.target, x.key as d_key,
      case q.target when 0 then x.a when 1 then x.b else x.c end as payload,
      sqrt((coalesce((q.a - x.a) * (q.a - x.a), 0) + coalesce((q.b - x.b) * (q.b - x.b), 0)
        + coalesce((q.c - x.c) * (q.c - x.c), 0))
        * (3 / nullif((case when (q.a - x.a) is null then 0 else 1 end
          + case when (q.b - x.b) is null then 0 else 1 end
          + case when (q.c - x.c) is null then 0 else 1 end), 0)::double)) as distance
    from q join x on case q.target when 0 then x.a when 1 then x.b else x.c end is not null),
  near as (select * from (select *, row_number() over (partition by q_key, target order by distance, d_key)
    as rank from d where distance is not null) where rank <= 5)"""


def _imputer(spark, sf, **kw):
    df = log_view(spark, sf, "id_log", *_HOLES, "num_log")
    return df, prep.DataImputer(key="id_log", **kw).fit(df)


@query("q_j6_null_aware_neighbors", f"""with {_E4_CTE} select q_key, target, rank, d_key,
    round(distance, 6) as distance, round(payload, 6) as payload from near""")
def j6(spark, sf):
    df, imputer = _imputer(spark, sf)
    return out(imputer.neighbors(df), "q_key", "target", "rank", "d_key", "distance", "payload")


@query("q_e4_knn_imputation", f"""with {_E4_CTE}, v as (select q_key, target, avg(payload) as v from near
    group by all) select key as id_log,
    round(coalesce(a, va.v, (select avg(a) from x)), 6) as ultimo_passo_correto,
    round(coalesce(b, vb.v, (select avg(b) from x)), 6) as tempo_passo,
    round(coalesce(c, vc.v, (select avg(c) from x)), 6) as idle_time_acumulado, num_log
    from x left join v va on key = va.q_key and va.target = 0 left join v vb on key = vb.q_key
      and vb.target = 1 left join v vc on key = vc.q_key and vc.target = 2
    join ({log_cte('id_log', 'num_log').replace('log as (', '', 1)[:-1]}) l on l.id_log = key""")
def e4(spark, sf):
    df, imputer = _imputer(spark, sf)
    return out(imputer.transform(df), "id_log", *_HOLES, "num_log")


def _fill_sql(agg):
    return f"with {log_cte('id_log', *_HOLES)} select id_log, " + ", ".join(
        f"round(coalesce({c}, (select {agg.format(c=c)} from log)), 6)::double as {c}" for c in _HOLES) + " from log"


@query("q_e5_mean_imputation", _fill_sql("avg({c})"))
def e5_mean(spark, sf):
    df, imputer = _imputer(spark, sf, numerical_strategy="mean")
    return out(imputer.transform(df), "id_log", *_HOLES)


@query("q_e5_median_imputation", _fill_sql("median({c})"))
def e5_median(spark, sf):
    df, imputer = _imputer(spark, sf, numerical_strategy="median")
    return out(imputer.transform(df), "id_log", *_HOLES)


@query("q_e6_mode_imputation", f"""with {log_cte('id_log', 'comportamento', 'estado_afetivo')},
    m1 as (select comportamento as v from log where comportamento is not null group by 1
      order by count(*) desc, 1 limit 1),
    m2 as (select estado_afetivo as v from log where estado_afetivo is not null group by 1
      order by count(*) desc, 1 limit 1)
    select id_log, coalesce(comportamento, (select v from m1)) as comportamento,
      coalesce(estado_afetivo, (select v from m2)) as estado_afetivo from log""")
def e6(spark, sf):
    df = log_view(spark, sf, "id_log", "comportamento", "estado_afetivo")
    return prep.DataImputer(key="id_log").fit_transform(df)


@query("q_e6_constant_imputation", f"""with {log_cte('id_log', 'comportamento', 'estado_afetivo')}
    select id_log, coalesce(comportamento, 'missing') as comportamento,
      coalesce(estado_afetivo, 'missing') as estado_afetivo from log""")
def e6_constant(spark, sf):
    df = log_view(spark, sf, "id_log", "comportamento", "estado_afetivo")
    return prep.DataImputer(key="id_log", categorical_strategy="constant").fit_transform(df)


@query("q_e7_fit_train_apply_all", f"""with {log_cte('id_log', 'num_dia', 'tempo_passo', 'idle_time_acumulado')}
    select id_log, num_dia,
    round(coalesce(tempo_passo, (select avg(tempo_passo) from log where num_dia <= 18)), 6) as tempo_passo,
    round(coalesce(idle_time_acumulado, (select avg(idle_time_acumulado) from log where num_dia <= 18)), 6)
      as idle_time_acumulado from log""")
def e7(spark, sf):
    """Fitted on the training days, applied to every row."""
    df = log_view(spark, sf, "id_log", "num_dia", "tempo_passo", "idle_time_acumulado")
    fitted = prep.DataImputer(key="id_log", numerical_strategy="mean").fit(df.where("num_dia <= 18"))
    return out(fitted.transform(df))


@query("q_e8_label_codes", f"""with {log_cte('id_log', 'comportamento', 'num_passos_equacao')},
    l as (select *, dense_rank() over (order by comportamento) - 1 as label from log where comportamento is not null)
    select id_log, comportamento, label::integer as label, num_passos_equacao::integer as step_code,
      comportamento as back from l""")
def e8(spark, sf):
    """Text labels and numeric labels (0..11, which must not sort as text), both ways."""
    df = log_view(spark, sf, "id_log", "comportamento", "num_passos_equacao").where("comportamento is not null")
    codes = prep.LabelCodes("comportamento").fit(df)
    steps = prep.LabelCodes("num_passos_equacao").fit(df)
    coded = steps.transform(codes.transform(df, "label"), "step_code")
    return codes.inverse(coded, "label", "back").select("id_log", "comportamento", "label", "step_code", "back")


_SCALED = ["tempo_equacao", "num_log", "constante"]


def _scaled_frame(spark, sf):
    return log_view(spark, sf, "id_log", "tempo_equacao", "num_log").withColumn("constante", F.lit(3.0))


_SCALED_CTE = log_cte("id_log", "tempo_equacao", "num_log") + ", x as (select *, 3.0::double as constante from log)"


def _std_sql(c, alias):
    return (f"round(({c} - avg({c}) over ()) / case when stddev_pop({c}) over () = 0 then 1 "
            f"else stddev_pop({c}) over () end, 6) as {alias}")


def _mm_sql(c, alias):
    return (f"round(({c} - min({c}) over ()) / (case when max({c}) over () = min({c}) over () then 1 "
            f"else max({c}) over () - min({c}) over () end)::double, 6) as {alias}")


@query("q_e9_standard_scaling", f"with {_SCALED_CTE} select id_log, "
       + ", ".join(_std_sql(c, c) for c in _SCALED) + " from x")
def e9(spark, sf):
    return out(prep.DataEncoder(_SCALED, scaling="standard").fit_transform(_scaled_frame(spark, sf)))


@query("q_e10_min_max_scaling", f"with {_SCALED_CTE} select id_log, "
       + ", ".join(_mm_sql(c, c) for c in _SCALED) + " from x")
def e10(spark, sf):
    return out(prep.DataEncoder(_SCALED, scaling="minmax").fit_transform(_scaled_frame(spark, sf)))


@query("q_e11_both_scalings", f"with {_SCALED_CTE} select id_log, "
       + ", ".join([_std_sql(c, f"{c}_std") for c in _SCALED] + [_mm_sql(c, f"{c}_mm") for c in _SCALED])
       + " from x")
def e11(spark, sf):
    return out(prep.DataEncoder(_SCALED, scaling="both").fit_transform(_scaled_frame(spark, sf)))


@query("q_e12_one_hot", """select event_id, case when event_type = 'error' then 1 else 0 end as event_type_error,
    case when event_type = 'purchase' then 1 else 0 end as event_type_purchase,
    case when event_type = 'signup' then 1 else 0 end as event_type_signup,
    case when event_type = 'view' then 1 else 0 end as event_type_view from events""")
def e12(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type")
    return prep.DataEncoder(nominal=["event_type"]).fit_transform(df)


@query("q_e12_sparse_one_hot", """with k as (select l_orderkey * 10 + l_linenumber as key, l_orderkey::varchar as v,
      l_returnflag as f, l_quantity::double as q from lineitem),
    d as (select v, row_number() over (order by v) - 1 as code from (select distinct v from k)),
    r as (select f, row_number() over (order by f) - 1 as code from (select distinct f from k))
    select key, 0::bigint as index, q as value from k where q <> 0 union all
    select key, code::bigint, 1.0::double from k join d using (v) where code > 0 union all
    select key, (select count(*) from d) - 1 + code, 1.0::double from k join r using (f) where code > 0""")
def e12_sparse(spark, sf):
    """A numeric column, one nominal column with a value per order, and a small one."""
    df = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_quantity").cast("double").alias("q"),
        F.col("l_orderkey").cast("string").alias("o"), F.col("l_returnflag").alias("f"))
    return prep.DataEncoder(["q"], ["o", "f"], scaling="none").fit(df).sparse(df, "key")


@query("q_e14_sparse_vectors", """with k as (select o_orderkey as key, o_custkey::varchar as v, o_orderstatus as f,
      o_totalprice::double as q from orders),
    d as (select v, row_number() over (order by v) - 1 as code from (select distinct v from k)),
    r as (select f, row_number() over (order by f) - 1 as code from (select distinct f from k)),
    e as (select key, 0 as index, q as value from k where q <> 0 union all
      select key, code, 1.0 from k join d using (v) where code > 0 union all
      select key, (select count(*) from d) - 1 + code, 1.0 from k join r using (f) where code > 0)
    select key, (select (select count(*) from d) + (select count(*) from r) - 1)::integer as width,
      coalesce(list(index::integer order by index) filter (index is not null), []) as indices,
      coalesce(list(value::double order by index) filter (index is not null), []) as "values"
    from k left join e using (key) group by key""")
def e14_sparse(spark, sf):
    """A numeric column, one nominal column with a value per customer, and a small one."""
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("double").alias("q"),
        F.col("o_custkey").cast("string").alias("o"), F.col("o_orderstatus").alias("f"))
    made = prep.DataEncoder(["q"], ["o", "f"], scaling="none").fit(df).sparse_vectors(df, "key")
    parts = F.from_json(F.to_json(F.struct("features")),
                        "features struct<type: int, size: int, indices: array<int>, values: array<double>>")
    return made.select("key", parts.alias("v")).select(
        "key", F.col("v.features.size").alias("width"), F.col("v.features.indices").alias("indices"),
        F.col("v.features.values").alias("values"))


_PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("q_e13_ordinal_codes", """select o_orderkey, (5 - left(o_orderpriority, 1)::integer)::integer
    as o_orderpriority_code from orders""")
def e13(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return prep.DataEncoder(ordinal={"o_orderpriority": _PRIORITIES}).fit_transform(df)


@query("q_e14_assembled_blocks", f"""with {log_cte('id_log', 'tempo_equacao', 'log_type', 'num_passos_corretos_eq')}
    select id_log, {_std_sql('tempo_equacao', 'tempo_equacao')},
    case when log_type = 'purchase' then 1 else 0 end as log_type_purchase,
    case when log_type = 'signup' then 1 else 0 end as log_type_signup,
    case when log_type = 'step_verification' then 1 else 0 end as log_type_step_verification,
    case when log_type = 'view' then 1 else 0 end as log_type_view,
    (4 - num_passos_corretos_eq)::integer as num_passos_corretos_eq_code, 6 as width from log""")
def e14(spark, sf):
    df = log_view(spark, sf, "id_log", "tempo_equacao", "log_type", "num_passos_corretos_eq")
    enc = prep.DataEncoder(["tempo_equacao"], ["log_type"], {"num_passos_corretos_eq": [4, 3, 2, 1, 0]}).fit(df)
    from pyspark.ml.functions import vector_to_array
    made = prep.to_vector(enc.transform(df), enc.output_columns)
    return out(made.withColumn("width", F.size(vector_to_array("features"))).drop("features"))


@query("q_e16_category_dictionary", f"""with {log_cte('log_type', 'estado_afetivo')}, u as (
    select distinct 'log_type' as feature, log_type as value from log union
    select distinct 'estado_afetivo', estado_afetivo from log where estado_afetivo is not null)
    select feature, (row_number() over (partition by feature order by value) - 1)::integer as code, value from u""")
def e16(spark, sf):
    df = log_view(spark, sf, "log_type", "estado_afetivo")
    enc = prep.DataEncoder(nominal=["log_type", "estado_afetivo"]).fit(df)
    return enc.feature_mapping(df)


@query("q_e16_wide_dictionary", """select 'o' as feature, (row_number() over (order by v) - 1)::integer as code, v as value
    from (select distinct l_orderkey::varchar as v from lineitem)""")
def e16_wide(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("o"))
    return prep.DataEncoder(nominal=["o"]).fit(df).feature_mapping(df)


# ---------------------------------------------------------------- neighbours and oversampling

def _dist(a, b):
    return (f"sqrt(list_sum(list_transform(range(1, 65), lambda i: ({a}[i]::double - {b}[i]::double)"
            f" * ({a}[i]::double - {b}[i]::double))))")


_SAME_CLASS = f"""near as (select * from (select a.vec_id as q_key, b.vec_id as d_key, a.label,
    {_dist('a.embedding', 'b.embedding')} as distance,
    row_number() over (partition by a.vec_id order by {_dist('a.embedding', 'b.embedding')}, b.vec_id) as rank
    from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id) where rank <= 5)"""


@query("q_j7_same_class_neighbors", f"""with {_SAME_CLASS} select q_key, rank, d_key,
    round(distance, 6) as distance from near""")
def j7(spark, sf):
    return out(neighbors.same_class_neighbors(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 5),
               "q_key", "rank", "d_key", "distance")


_TRAIN_TEST = """e as (select *, row_number() over (partition by label order by
    md5(concat(vec_id::varchar, '-42')), vec_id) as r, count(*) over (partition by label) as n from embeddings),
  tr as (select * from e where r > round(n * 0.2)), te as (select * from e where r <= round(n * 0.2))"""
_CROSS = f"""{_TRAIN_TEST}, near as (select * from (select a.vec_id as q_key, a.label as truth, b.vec_id as d_key,
    b.label as label, {_dist('a.embedding', 'b.embedding')} as distance,
    row_number() over (partition by a.vec_id order by {_dist('a.embedding', 'b.embedding')}, b.vec_id) as rank
    from te a cross join tr b) where rank <= 5)"""


def _train_test(spark, sf):
    df = split.split_by_target(table(spark, sf, "embeddings"), "label", "vec_id", 0.2)
    return df.where("split = 'train'"), df.where("split = 'test'")


@query("q_j8_cross_neighbors", f"""with {_CROSS} select q_key, rank, d_key, round(distance, 6) as distance,
    label::double as payload from near""")
def j8(spark, sf):
    train, test = _train_test(spark, sf)
    return out(neighbors.cross_neighbors(test, train, "vec_id", "embedding", "label", 5),
               "q_key", "rank", "d_key", "distance", "payload")


@query("q_m6_knn_uniform", f"""with {_CROSS}, v as (select q_key, label, count(*) as w from near group by all)
    select q_key, first(label order by w desc, label)::double as prediction from v group by 1""")
def m6(spark, sf):
    train, test = _train_test(spark, sf)
    near = neighbors.cross_neighbors(test, train, "vec_id", "embedding", "label", 5)
    return neighbors.predict_by_vote(neighbors.vote(near, "uniform"))


@query("q_m6_knn_distance", f"""with {_CROSS}, v as (select q_key, label, sum(1 / distance) as w from near
    group by all) select q_key, first(label order by w desc, label)::double as prediction from v group by 1""")
def m6_distance(spark, sf):
    train, test = _train_test(spark, sf)
    near = neighbors.cross_neighbors(test, train, "vec_id", "embedding", "label", 5)
    return neighbors.predict_by_vote(neighbors.vote(near, "distance"))


def _recalled(found, exact) -> DataFrame:
    """Queries that got their neighbours, and whether 0.9 of the true ones are among them."""
    exact, found = materialise(exact, "exact"), materialise(found, "found")
    hit = exact.join(found.select("q_key", "d_key"), ["q_key", "d_key"], "left_semi")
    hits = hit.agg(F.count(F.lit(1)).alias("hits"))
    return (found.agg(F.count_distinct("q_key").alias("queries"), F.count(F.lit(1)).alias("found"))
            .crossJoin(hits).crossJoin(exact.agg(F.count(F.lit(1)).alias("true")))      # one row each
            .select("queries", "found", (F.col("hits") >= 0.9 * F.col("true")).alias("recall_reached")))


@query("q_j7_approximate_recall", f"""with {_SAME_CLASS} select count(distinct q_key) as queries, count(*) as found,
    true as recall_reached from near""")
def j7_approximate(spark, sf):
    df = table(spark, sf, "embeddings")
    args = ("vec_id", "embedding", "label", 5)
    return _recalled(neighbors.same_class_neighbors(df, *args, recall=0.9, leaf=32),
                     neighbors.same_class_neighbors(df, *args))


@query("q_j8_approximate_recall", f"""with {_CROSS} select count(distinct q_key) as queries, count(*) as found,
    true as recall_reached from near""")
def j8_approximate(spark, sf):
    train, test = _train_test(spark, sf)
    args = (test, train, "vec_id", "embedding", "label", 5)
    return _recalled(neighbors.cross_neighbors(*args, recall=0.9, leaf=32), neighbors.cross_neighbors(*args))


def _wanted(strategy):
    case = {"auto": "case when c <> big then top else n end", "minority": "case when c = small then top else n end",
            "not minority": "case when c <> small then top else n end", "all": "top",
            "not majority": "case when c <> big then top else n end"}[strategy]
    return f"""select '{strategy}' as strategy, c as class, n, {case} as wanted,
      {case} - n as need from x"""


_STRATEGY_LIST = ["auto", "minority", "not minority", "not majority", "all"]


@query("q_x6_target_counts", """with k as (select label as c, count(*) as n from embeddings group by 1),
    x as (select *, max(n) over () as top, first(c) over (order by n desc, c) as big,
      first(c) over (order by n, c) as small from k) """ + " union all ".join(_wanted(s) for s in _STRATEGY_LIST))
def x6(spark, sf):
    df, made = table(spark, sf, "embeddings"), None
    for s in _STRATEGY_LIST:
        one = prep.target_count_table(df, "label", s).withColumn("strategy", F.lit(s))
        made = one if made is None else made.unionByName(one)
    return made.select("strategy", "class", "n", "wanted", "need")


_DRAW = "concat_ws('-', label::varchar, i::varchar, '{}')"


@query("q_x5_smote", f"""with {_SAME_CLASS}, k as (select label, count(*) as n, max(count(*)) over () as top
    from embeddings group by 1),
  need as (select label, n, unnest(range(1, top - n + 1)) as i from k where top > n),
  members as (select vec_id, label, row_number() over (partition by label order by {_h('vec_id', '42-m')}, vec_id)
    as place from embeddings),
  drawn as (select label, i, floor({_u(_DRAW.format('a'), 42)} * n)::bigint + 1 as place,
    floor({_u(_DRAW.format('b'), 42)} * 5)::bigint + 1 as rank, {_u(_DRAW.format('c'), 42)} as gap from need),
  picked as (select d.label, d.i, m.vec_id as base, near.d_key as neighbor, gap from drawn d
    join members m on d.label = m.label and d.place = m.place
    join near on near.q_key = m.vec_id and near.rank = d.rank),
  made as (select p.label, p.i, p.base, p.neighbor, list_transform(range(1, 65),
    lambda j: a.embedding[j]::double + gap * (b.embedding[j]::double - a.embedding[j]::double)) as v
    from picked p join embeddings a on a.vec_id = p.base join embeddings b on b.vec_id = p.neighbor)
  select label, i, base, neighbor, round(v[1], 6) as v0, round(v[64], 6) as v63,
    round(list_sum(v), 5) as total from made""")
def x5(spark, sf):
    made = prep.smote_rows(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    total = F.aggregate("vec", F.lit(0.0), lambda a, b: a + b)
    return made.select("label", "i", "base", "neighbor", rounded(F.get("vec", F.lit(0))).alias("v0"),
                       rounded(F.get("vec", F.lit(63))).alias("v63"), rounded(total, 5).alias("total"))


@query("q_x5_balanced_counts", """with k as (select label, count(*) as n from embeddings group by 1)
    select label, false as synthetic, n from k union all
    select label, true, (select max(n) from k) - n from k where n < (select max(n) from k)""")
def x5_counts(spark, sf):
    grown = prep.balance_data(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return grown.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("q_class_weights", """with k as (select label, count(*) as n from embeddings group by 1)
    select vec_id, label, round((select sum(n) from k) / ((select count(*) from k) * n)::double, 6) as weight
    from embeddings join k using (label)""")
def weights(spark, sf):
    return out(prep.with_class_weights(table(spark, sf, "embeddings"), "label"), "vec_id", "label", "weight")
