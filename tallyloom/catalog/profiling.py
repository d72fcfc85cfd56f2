"""Profiling queries: distributions, constants, missing values, associations, mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.base import log_cte, log_view, out, query, table
from tallyloom.operators import clean, phik, prep, profile

_SHARE = "count(*) / sum(count(*)) over ()::double"


@query("q_a1_class_distribution", f"""with {log_cte('comportamento')} select comportamento as class,
    count(*) as n, round({_SHARE}, 6) as share, printf('%.2f%%', 100 * {_SHARE}) as percent
    from log where comportamento is not null group by 1""")
def a1(spark, sf):
    return out(profile.class_distribution(log_view(spark, sf, "comportamento"), "comportamento"))


@query("q_a2_group_class_counts", f"""with {log_cte('aluno', 'comportamento')}
    select aluno, comportamento, count(*) as n from log group by all""")
def a2(spark, sf):
    return profile.group_class_counts(log_view(spark, sf, "aluno", "comportamento"), "aluno", "comportamento")


@query("q_a2_smallest_group", f"""with {log_cte('aluno')}, c as (select aluno, count(*) as n from log group by 1)
    select min(n) as min_rows, count(*) as n_groups from c""")
def a2_min(spark, sf):
    return profile.smallest_group(log_view(spark, sf, "aluno"), "aluno")


@query("q_a3_repeated_pairs", """select l_orderkey, l_linenumber, count(*) as n from lineitem
    group by all having count(*) <> 1""")
def a3(spark, sf):
    return profile.repeated_pairs(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("q_a3_single_pairs", """with c as (select count(*) as n from lineitem group by l_orderkey, l_linenumber)
    select count(*) filter (n = 1) as n_single from c""")
def a3_single(spark, sf):
    return profile.single_pairs(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("q_a4_value_counts", f"""with {log_cte('log_type', 'comportamento', 'num_passos_equacao')},
    u as (select 'log_type' as feature, log_type as value from log union all
      select 'comportamento', comportamento from log union all
      select 'num_passos_equacao', num_passos_equacao::varchar from log),
    c as (select feature, value, count(*) as n from u where value is not null group by all)
    select *, count(*) over (partition by feature) as n_distinct from c""")
def a4(spark, sf):
    cols = ["log_type", "comportamento", "num_passos_equacao"]
    return profile.value_counts(log_view(spark, sf, *cols), cols)


def _with_constants(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_tax", "l_returnflag", F.lit(1).alias("one"), F.lit("x").alias("same_text"),
        F.lit(None).cast("double").alias("all_null"),
        F.when(F.col("l_quantity") > 25, 7.0).alias("seven_or_null"),
        F.when(F.col("l_quantity") == 50, 1).otherwise(0).alias("near"),
        F.when(F.col("l_quantity") == 1, "b").otherwise("a").alias("near_text"))


_CONSTANTS = """x as (select l_quantity, l_tax, l_returnflag, 1 as one, 'x' as same_text,
    null::double as all_null, case when l_quantity > 25 then 7.0::double end as seven_or_null,
    case when l_quantity = 50 then 1 else 0 end as near,
    case when l_quantity = 1 then 'b' else 'a' end as near_text from lineitem)"""
_CONSTANT_COLS = ["l_quantity", "l_tax", "l_returnflag", "one", "same_text", "all_null", "seven_or_null",
                  "near", "near_text"]


@query("q_a5_constant_columns", f"with {_CONSTANTS}, d as (" + " union all ".join(
    f"select '{c}' as feature, count(distinct {c}) as n from x" for c in _CONSTANT_COLS)
    + ") select feature from d where n = 1")
def a5(spark, sf):
    return profile.constant_columns(_with_constants(spark, sf))


@query("q_a6_low_variance", f"with {_CONSTANTS}, u as (" + " union all ".join(
    f"select '{c}' as feature, {c}::varchar as v from x" for c in _CONSTANT_COLS) + """),
    c as (select feature, v, count(*) as n from u where v is not null group by all),
    s as (select feature, max(n) / sum(n)::double as share from c group by 1)
    select feature, round(share, 6) as share from s where share >= 0.95""")
def a6(spark, sf):
    return out(profile.low_variance_columns(_with_constants(spark, sf), 0.95))


_MISSING = ["id_log", "comportamento", "estado_afetivo", "tempo_passo", "ultimo_passo_correto", "num_log"]


@query("q_a7_missing_info", f"with {log_cte(*_MISSING)}, u as (" + " union all ".join(
    f"select '{c}' as \"column\", count(*) - count({c}) as n_missing, count(*) as t, "
    f"'{'string' if c in ('comportamento', 'estado_afetivo') else 'bigint'}' as dtype from log"
    for c in _MISSING) + """) select "column", n_missing, round(100 * (n_missing / t::double), 6) as percent, dtype
    from u where n_missing > 0""")
def a7(spark, sf):
    return out(profile.missing_info(log_view(spark, sf, *_MISSING)))


@query("q_a8_numeric_ranges", f"""with {log_cte('num_log', 'tempo_passo', 'efetividade_passos_eq')}
    select 'num_log' as feature, 'int' as kind, min(num_log) || ' a ' || max(num_log) as "range" from log
    union all select 'tempo_passo', 'int', min(tempo_passo) || ' a ' || max(tempo_passo) from log
    union all select 'efetividade_passos_eq', 'real', min(efetividade_passos_eq) || ' a '
      || max(efetividade_passos_eq) from log""")
def a8(spark, sf):
    cols = ["num_log", "tempo_passo", "efetividade_passos_eq"]
    return profile.numeric_ranges(log_view(spark, sf, *cols), cols)


@query("q_a9_category_mapping", f"""with {log_cte('log_type', 'estado_afetivo')},
    u as (select 'log_type' as feature, log_type as value from log union all
      select 'estado_afetivo', estado_afetivo from log),
    d as (select feature, value, row_number() over (partition by feature order by value) - 1 as code
      from (select distinct feature, value from u where value is not null)),
    c as (select feature, value, count(*) as n from u group by all),
    t as (select feature, sum(n) as t from c group by 1)
    select d.feature, d.code, d.value, coalesce(c.n, 0) as n,
      printf('%.2f%%', 100 * (coalesce(c.n, 0) / t.t::double)) as pct
    from d left join c using (feature, value) join t on d.feature = t.feature""")
def a9(spark, sf):
    df = log_view(spark, sf, "log_type", "estado_afetivo")
    return profile.mapping_report(prep.dictionary(df, ["log_type", "estado_afetivo"]), df)


_WIDE_SQL = """w as (select 'order' as feature, l_orderkey::varchar as value, null::double as x from lineitem
    union all select 'part', l_partkey::varchar, l_partkey::double from lineitem)"""


@query("q_a9_wide_mapping", f"""with {_WIDE_SQL},
    c as (select feature, value, any_value(x) as x, count(*) as n from w group by all)
    select feature, (row_number() over (partition by feature order by x nulls first, value) - 1)::integer as code, value, n from c""")
def a9_wide(spark, sf):
    """Columns with more values than any dictionary in an expression could hold."""
    df = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("order"),
                                             F.col("l_partkey").alias("part"))
    return profile.mapping_report(prep.dictionary(df, ["order", "part"]), df).drop("pct")


@query("q_a10_class_mapping", f"""with {log_cte('comportamento')}, c as (select comportamento as class,
    count(*) as n from log where comportamento is not null group by 1)
    select row_number() over (order by class) - 1 as code, class, n,
      printf('%.2f%%', 100 * (n / sum(n) over ()::double)) as pct from c""")
def a10(spark, sf):
    return profile.target_mapping(log_view(spark, sf, "comportamento"), "comportamento")


# ---------------------------------------------------------------- associations

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "mix", "one"]


def _numbers(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount",
        F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("l_tax"),
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("mix"), F.lit(1.0).alias("one"), "l_returnflag")


_NUMBERS_CTE = """x as (select l_quantity, l_extendedprice, l_discount,
    case when l_returnflag <> 'R' then l_tax end as l_tax, l_quantity * 2 + l_tax as mix,
    1.0::double as one, l_returnflag from lineitem)"""


def _pair_sql(cols, source):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j:
                parts.append(f"""select {i} as i, '{a}' as f1, {j} as j, '{b}' as f2,
                  count(*) filter ({a} is not null and {b} is not null) as n,
                  case when var_pop({a}) filter ({b} is not null) > 0
                    and var_pop({b}) filter ({a} is not null) > 0
                    then round(corr({a}, {b}), 6) end as r from {source}""")
    return " union all ".join(parts)


@query("q_a15_correlation_pairs", f"with {_NUMBERS_CTE} {_pair_sql(_NUMBERS, 'x')}")
def a15(spark, sf):
    return out(profile.correlation_pairs(_numbers(spark, sf), _NUMBERS))


@query("q_a15_correlation_wide", """with u as (select vec_id, unnest(embedding)::double as x,
      unnest(range(0, len(embedding))) as p from embeddings)
    select a.p as i, b.p as j, count(*) as n, round(corr(a.x, b.x), 6) as r
    from u a join u b on a.vec_id = b.vec_id and a.p < b.p group by 1, 2""")
def a15_wide(spark, sf):
    df = table(spark, sf, "embeddings")
    x = F.col("embedding").cast("array<double>")
    wide = df.select(*[F.get(x, F.lit(i)).alias(f"e{i}") for i in range(64)])
    return out(profile.correlation_pairs(wide, wide.columns), "i", "j", "n", "r")


def _eta_sql(target, features, source, zero=False):
    parts = []
    for f in features:
        x = f"coalesce({f}, 0)" if zero else f
        parts.append(f"""select '{f}' as feature, coalesce(sqrt(sum(n * (m - g) * (m - g)) /
          nullif(sum(n * (m - g) * (m - g)) + sum(n * v), 0)), 0) as eta from (
          select count({x}) as n, avg({x}) as m, var_pop({x}) as v,
          (select avg({x}) from {source} where {target} is not null) as g
          from {source} where {target} is not null group by {target} having count({x}) > 0)""")
    return " union all ".join(parts)


_ETA = ["num_click_acumulado", "tempo_passo", "tempo_equacao", "num_log"]


@query("q_a16_correlation_ratio", f"with {log_cte('comportamento', *_ETA)}, e as ("
       f"{_eta_sql('comportamento', _ETA, 'log')}) select feature, round(eta, 6) as eta from e")
def a16(spark, sf):
    return out(profile.correlation_ratio(log_view(spark, sf, "comportamento", *_ETA), "comportamento", _ETA))


@query("q_a16_correlation_ratio_zero", f"with {log_cte('comportamento', *_ETA)}, e as ("
       f"{_eta_sql('comportamento', _ETA, 'log', True)}) select feature, round(eta, 6) as eta from e")
def a16_zero(spark, sf):
    return out(profile.correlation_ratio(log_view(spark, sf, "comportamento", *_ETA), "comportamento",
                                         _ETA, nulls="zero"))


def _related(spark, sf):
    return log_view(spark, sf, "comportamento", "num_click_acumulado", "num_click_passo", "tempo_equacao",
                    "tempo_passo").withColumns({
        "clicks_all": F.col("num_click_acumulado") + F.col("num_click_passo"),
        "time_all": F.col("tempo_equacao") + F.coalesce(F.col("num_click_passo"), F.lit(0))})


_RELATED = ["num_click_acumulado", "num_click_passo", "tempo_equacao", "tempo_passo", "clicks_all", "time_all"]
_RELATED_CTE = log_cte("comportamento", *_RELATED[:4]) + """, x as (select *,
    num_click_acumulado + num_click_passo as clicks_all,
    tempo_equacao + coalesce(num_click_passo, 0) as time_all from log)"""


def _pruning_sql(first_wins, otherwise):
    return f"""with {_RELATED_CTE}, p as ({_pair_sql(_RELATED, 'x')}),
      e as ({_eta_sql('comportamento', _RELATED, 'x')})
      select distinct case when a.eta > b.eta then {first_wins} else {otherwise} end as feature
      from p join e a on p.f1 = a.feature join e b on p.f2 = b.feature where abs(r) > 0.9"""


@query("q_a17_multicollinearity", _pruning_sql("f2", "f1"))
def a17(spark, sf):
    return clean.highly_correlated(_related(spark, sf), "comportamento", 0.90, "higher")


@query("q_a17_multicollinearity_lower", _pruning_sql("f1", "f2"))
def a17_lower(spark, sf):
    return clean.highly_correlated(_related(spark, sf), "comportamento", 0.90, "lower")


@query("q_a18_pruning_numeric_target", f"""with {_RELATED_CTE}, p as ({_pair_sql(_RELATED[1:], 'x')}),
    t as ({' union all '.join(f"select '{c}' as feature, abs(corr({c}, num_click_acumulado)) as s from x"
                              for c in _RELATED[1:])})
    select distinct case when a.s > b.s then f2 else f1 end as feature
    from p join t a on p.f1 = a.feature join t b on p.f2 = b.feature where abs(r) > 0.9""")
def a18(spark, sf):
    return clean.highly_correlated_to_numeric(_related(spark, sf), "num_click_acumulado", 0.90)


_PROFILE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("q_a19_column_profile", f"with {_NUMBERS_CTE} " + " union all ".join(
    f"""select '{c}' as feature, count({c}) as n, count(*) - count({c}) as n_null,
    count(distinct {c}) as n_distinct, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
    round(min({c}), 4) as min, round(quantile_cont({c}, 0.25), 4) as q25,
    round(quantile_cont({c}, 0.5), 4) as q50, round(quantile_cont({c}, 0.75), 4) as q75,
    round(max({c}), 4) as max from x""" for c in _PROFILE))
def a19(spark, sf):
    return out(profile.describe_columns(_numbers(spark, sf), _PROFILE), digits=4)


_ASSOCIATED = [("num_click_passo", "num_passos_equacao"), ("num_passos_corretos_eq", "tempo_passo")]


def _association_sql(a, b):
    """Spearman by average ranks; Kendall and chi-square from all pairs of value cells."""
    return f"""select '{a}' as f1, '{b}' as f2, (select corr(rx, ry) from (select
        rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as rx,
        rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as ry
        from log where {a} is not null and {b} is not null)) as spearman,
      (with c as (select {a} as x, {b} as y, count(*) as n from log
          where {a} is not null and {b} is not null group by all),
        t as (select sum(n)::double as tot from c),
        tx as (select sum(m * (m - 1) / 2) as s from (select sum(n)::double as m from c group by x)),
        ty as (select sum(m * (m - 1) / 2) as s from (select sum(n)::double as m from c group by y))
        select sum(p.n::double * q.n * sign(p.x - q.x) * sign(p.y - q.y)) / 2 /
          sqrt((any_value(t.tot) * (any_value(t.tot) - 1) / 2 - any_value(tx.s))
             * (any_value(t.tot) * (any_value(t.tot) - 1) / 2 - any_value(ty.s)))
        from c p, c q, t, tx, ty) as kendall,
      (with c as (select {a} as x, {b} as y, count(*)::double as n from log
          where {a} is not null and {b} is not null group by all),
        m as (select n, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny,
          sum(n) over () as tot from c)
        select any_value(tot) * (sum(n * n / (nx * ny)) - 1) from m) as chi2,
      (select least(count(distinct {a}), count(distinct {b})) - 1 from log
        where {a} is not null and {b} is not null) as k,
      (select count(*) from log where {a} is not null and {b} is not null) as total"""


@query("q_a19_associations", f"""with {log_cte(*[c for p in _ASSOCIATED for c in p])},
    a as ({' union all '.join(_association_sql(*p) for p in _ASSOCIATED)})
    select f1, f2, round(spearman, 6) as spearman, round(kendall, 6) as kendall, round(chi2, 4) as chi2,
    round(sqrt(greatest(chi2, 0) / total / k), 6) as cramers_v from a""")
def a19_pairs(spark, sf):
    df = log_view(spark, sf, *[c for p in _ASSOCIATED for c in p])
    found = profile.pair_associations(df, _ASSOCIATED).withColumn("chi2", F.round("chi2", 4))
    return out(found)


_PHI_K = ["num_click_passo", "num_passos_equacao", "tempo_passo", "log_type"]


@query("q_a19_phi_k")
def a19_phi_k(spark, sf):
    found = phik.phi_k_pairs(log_view(spark, sf, *_PHI_K), _PHI_K)
    return out(found, "f1", "f2", "n", "phi_k")


def _bin_sql(c):
    if c == "log_type":
        return c
    return (f"case when {c} is not null then lpad(least(floor(({c}::double - min({c}) over ()) * 10 / "
            f"(max({c}) over () - min({c}) over ())), 9)::integer::varchar, 4, '0') end as {c}")


@query("q_a19_phi_k_facts", f"""with {log_cte(*_PHI_K)}, c as (select {', '.join(map(_bin_sql, _PHI_K))} from log),
    p as ({' union all '.join(f"select '{a}' as f1, '{b}' as f2, {a} as x, {b} as y, count(*)::double as n from c "
                              f"where {a} is not null and {b} is not null group by all"
                              for i, a in enumerate(_PHI_K) for b in _PHI_K[i + 1:])}),
    m as (select *, sum(n) over (partition by f1, f2, x) as nx, sum(n) over (partition by f1, f2, y) as ny,
      sum(n) over (partition by f1, f2) as t from p),
    s as (select f1, f2, any_value(t)::bigint as n, count(distinct x)::integer as "rows", count(distinct y)::integer as columns,
      any_value(t) * (sum(n * n / (nx * ny)) - 1) as chi2 from m group by f1, f2)
    select f1, f2, n, "rows", columns, round(chi2, 3) as chi2,
      chi2 > ("rows" - 1) * (columns - 1) + sqrt(2 * ("rows" - 1) * (columns - 1)) as correlated from s""")
def a19_phi_k_facts(spark, sf):
    """The counted tables: their chi-square, and that phi_k is 0 exactly below the pedestal."""
    found = phik.phi_k_pairs(log_view(spark, sf, *_PHI_K), _PHI_K)
    return found.select("f1", "f2", "n", "rows", "columns", F.round("chi2", 3).alias("chi2"),
                        (F.col("phi_k") > 0).alias("correlated"))


@query("q_a21_label_index", """with l as (select distinct label from embeddings)
    select label as class, row_number() over (order by label) - 1 as idx from l""")
def a21(spark, sf):
    from tallyloom.operators.evaluate import label_index
    return label_index(table(spark, sf, "embeddings"), ["label"])


@query("q_a22_columns_with_nulls", f"with {log_cte(*_MISSING)} " + " union all ".join(
    f"select '{c}' as \"column\", count(*) > count({c}) as has_null from log" for c in _MISSING))
def a22(spark, sf):
    return profile.columns_with_nulls(log_view(spark, sf, *_MISSING))
