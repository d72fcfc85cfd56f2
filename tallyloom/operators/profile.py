"""Data-quality profiling: distributions, constants, missing values, associations, mappings.

Per-column results come from one wide aggregate wherever possible (partial aggregates, no data
shuffle). Exact order statistics go through counted distinct values, so repeated values collapse
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.expr import col, finite_or_null, percent_text, rounded, safe_div
from tallyloom.functions.scale import (
    bounded_rows, materialise, running_total,
)



def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count, share and percent text of each non-null class."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).alias("class")).agg(
        F.count(F.lit(1)).alias("n"))
    share = safe_div(F.col("n"), F.sum("n").over(Window.partitionBy()))
    return counts.withColumn("share", share).withColumn("percent", percent_text(F.col("share")))


def group_class_counts(df: DataFrame, group: str, target: str) -> DataFrame:
    return df.groupBy(group, target).agg(F.count(F.lit(1)).alias("n"))


def smallest_group(df: DataFrame, group: str) -> DataFrame:
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("min_rows"), F.count(F.lit(1)).alias("n_groups"))


def repeated_pairs(df: DataFrame, c1: str, c2: str) -> DataFrame:
    """Pairs of values that do not occur exactly once, with their counts."""
    return df.groupBy(c1, c2).agg(F.count(F.lit(1)).alias("n")).where("n <> 1")


def single_pairs(df: DataFrame, c1: str, c2: str) -> DataFrame:
    """How many pairs of values occur exactly once."""
    sizes = df.groupBy(c1, c2).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count_if(F.col("n") == 1).alias("n_single"))


def long_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "feature", "value")


def long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (df.select(*[col(c).cast("double").alias(c) for c in columns])
              .unpivot([], list(columns), "feature", "value").where(F.col("value").isNotNull()))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n, n_distinct): counts of every non-null value of the listed columns."""
    counts = (long_text(df, columns).where(F.col("value").isNotNull())
              .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    distinct = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))
    return counts.join(F.broadcast(distinct), "feature")   # one row per listed column


def distinct_counts(df: DataFrame, columns: Sequence[str], sure_above: int | None = None
                    ) -> DataFrame:
    """(feature, n_distinct) of the non-null values.

    With ``sure_above`` a cheap sketch settles the wide columns first: a sketch cannot show more
    than about its true count on few values, so an estimate of twice the bound or more proves that
    the bound is passed, and only the remaining columns are counted exactly. For those settled
    columns ``n_distinct`` is the estimate.
    """
    settled: dict[str, int] = {}
    if sure_above is not None:
        rough = df.agg(*[F.approx_count_distinct(col(c)).alias(c) for c in columns]).first()
        settled = {c: rough[c] for c in columns if rough[c] >= 2 * max(sure_above, 8)}
    open_columns = [c for c in columns if c not in settled]
    spark = df.sparkSession
    out = None
    if settled:
        out = spark.createDataFrame(list(settled.items()), "feature string, n_distinct long")
    if open_columns:
        found = long_text(df, open_columns).groupBy("feature").agg(
            F.count_distinct("value").alias("n_distinct"))
        out = found if out is None else out.unionByName(found)
    return out


def vector_distinct_counts(df: DataFrame, features: str, sure_above: int) -> dict[int, int]:
    """Distinct values per position of a vector column, settled as in ``distinct_counts``."""
    from pyspark.ml.functions import vector_to_array
    long = df.select(F.posexplode(vector_to_array(features)).alias("i", "x"))
    rough = long.groupBy("i").agg(F.approx_count_distinct("x").alias("n"))
    out = {r["i"]: r["n"] for r in bounded_rows(rough, 1_000_000, "vector positions")}
    unsure = [i for i, n in out.items() if n < 2 * max(sure_above, 8)]
    if unsure:
        exact = long.where(F.col("i").isin(unsure)).groupBy("i").agg(F.count_distinct("x").alias("n"))
        out.update({r["i"]: r["n"] for r in bounded_rows(exact, len(unsure), "vector positions")})
    return out


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with exactly one distinct non-null value: min = max, in one pass."""
    columns = list(columns or df.columns)
    one = df.agg(*[(F.min(col(c)) == F.max(col(c))).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "constant").where("constant").select("feature")


def low_variance_columns(df: DataFrame, threshold: float = 0.95,
                         columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, share) of columns whose most frequent value covers ``threshold`` of non-nulls.

    A value covering well over half of the rows is the median, so the candidate comes from an
    approximate median (of the value, or of a 32-bit hash for text) and is then counted exactly:
    two aggregate passes, no shuffle of values. Low thresholds count all values instead.
    """
    columns = list(columns or df.columns)
    if threshold <= 0.6:
        return _top_shares(df, columns).where(F.col("share") >= threshold)
    text = [c for c in columns if not is_numeric(df, c)]
    def key(c: str) -> Column:
        return F.when(col(c).isNotNull(), F.hash(col(c))) if c in text else col(c).cast("double")
    medians = df.agg(*[F.percentile_approx(key(c), 0.5, 1000).alias(c) for c in columns]).first()
    aggs = []
    for c in columns:
        here = key(c) == F.lit(medians[c])
        aggs.append(F.struct(
            F.lit(c).alias("feature"), F.count(col(c)).alias("n"), F.count_if(here).alias("hits"),
            F.min(F.when(here, col(c).cast("string"))).alias("lo"),
            F.max(F.when(here, col(c).cast("string"))).alias("hi")))
    found = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    found = materialise(found, "shares")
    clashing = [r[0] for r in bounded_rows(
        found.where(F.col("feature").isin(text) & (F.col("lo") != F.col("hi"))).select("feature"),
        len(columns), "hash clashes")] if text else []
    out = (found.where(~F.col("feature").isin(clashing)) if clashing else found).select(
        "feature", safe_div("hits", "n").alias("share"))
    if clashing:
        out = out.unionByName(_top_shares(df, clashing))
    return out.where(F.col("share") >= threshold)


def _top_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = value_counts(df, columns)
    return counts.groupBy("feature").agg(
        safe_div(F.max("n"), F.sum("n")).alias("share"))


def missing_info(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_missing, percent, dtype) of the columns that hold nulls."""
    columns = list(columns or df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(col(c).isNull()).alias("n_missing"),
                      F.count(F.lit(1)).alias("_n"), F.lit(kinds[c]).alias("dtype"))
             for c in columns]
    out = df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    return out.where("n_missing > 0").select(
        "column", "n_missing", (safe_div("n_missing", "_n") * 100).alias("percent"), "dtype")


def columns_with_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    one = df.agg(*[F.bool_or(col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "has_null")


def numeric_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, kind, range text 'min a max') of numeric columns."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    cells = [F.struct(F.lit(c).alias("feature"),
                      F.lit("int" if isinstance(df.schema[c].dataType, whole) else "real").alias("kind"),
                      F.concat(F.min(col(c)).cast("string"), F.lit(" a "),
                               F.max(col(c)).cast("string")).alias("range")) for c in columns]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def mapping_report(dictionary: DataFrame, df: DataFrame) -> DataFrame:
    """(feature, code, value, n, pct): a fitted dictionary beside the counts in ``df``.

    Percentages are of all rows of ``df``, nulls included, as codes absent there count 0.
    """
    features = [r[0] for r in bounded_rows(
        dictionary.select("feature").distinct(), len(df.columns), "mapped features")]
    counts = (long_text(df, features).groupBy("feature", "value")
              .agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy("feature").agg(F.sum("n").alias("_t"))
    joined = (dictionary.join(counts, ["feature", "value"], "left")
              .join(F.broadcast(total), "feature"))           # one row per mapped feature
    n = F.coalesce("n", F.lit(0))
    return joined.select("feature", "code", "value", n.alias("n"),
                         percent_text(safe_div(n, F.col("_t"))).alias("pct"))


def target_mapping(df: DataFrame, target: str) -> DataFrame:
    """(code, class, n, pct) in code order, codes by sorted class."""
    counts = class_distribution(df, target)
    by_class = Window.partitionBy().orderBy("class")          # one row per class
    return counts.select((F.row_number().over(by_class) - 1).alias("code"), "class", "n",
                         F.col("percent").alias("pct"))


# ---------------------------------------------------------------- associations

def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, f1, j, f2, n, r): Pearson r over the rows with two finite numbers, i < j; null if undefined."""
    return _pairs_by_matrix(df, list(columns))


def _r(cov: Column, vx: Column, vy: Column) -> Column:
    r = F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))
    return F.when((vx > 0) & (vy > 0), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def _pairs_by_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass for any width: each task sums its rows into matrices, which are then added up."""
    k = len(columns)
    numbers = df.select(*[finite_or_null(c).alias(f"c{i}") for i, c in enumerate(columns)])
    centre_row = numbers.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(k)]).first()
    centre = np.array([v if v is not None else 0.0 for v in centre_row])
    names = np.array(columns, dtype=object)
    upper = np.triu_indices(k, 1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((6, k, k))
        seen = False
        for pdf in batches:
            x = pdf.to_numpy(dtype="float64", na_value=np.nan) - centre
            known = np.isfinite(x)
            x, m = np.where(known, x, 0.0), known.astype("float64")
            sq = x * x
            sums += np.stack([m.T @ m, x.T @ m, m.T @ x, x.T @ x, sq.T @ m, m.T @ sq])
            seen = True
        if seen:
            out = {name: sums[s][upper] for s, name in enumerate(("n", "sx", "sy", "sxy", "sxx", "syy"))}
            yield pd.DataFrame({"i": upper[0].astype("int32"), "j": upper[1].astype("int32"), **out})

    schema = "i int, j int, n double, sx double, sy double, sxy double, sxx double, syy double"
    total = (numbers.mapInPandas(partial, schema).groupBy("i", "j")
             .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")]))
    n = F.col("n")
    def spread(sq: str, s: str) -> Column:
        v = F.try_divide(F.col(sq), n) - F.pow(F.try_divide(F.col(s), n), F.lit(2.0))
        # rounding noise of a constant column must not look like spread
        return F.when(v > F.lit(1e-12) * F.try_divide(F.col(sq), n), v).otherwise(F.lit(0.0))
    cov = F.try_divide(F.col("sxy"), n) - F.try_divide(F.col("sx"), n) * F.try_divide(F.col("sy"), n)
    labels = F.array(*[F.lit(c) for c in names])
    return total.select(
        "i", F.get(labels, F.col("i")).alias("f1"), "j", F.get(labels, F.col("j")).alias("f2"),
        n.cast("long").alias("n"), _r(cov, spread("sxx", "sx"), spread("syy", "sy")).alias("r"))


def correlation_ratio(df: DataFrame, target: str, features: Sequence[str],
                      nulls: str = "drop") -> DataFrame:
    """(feature, eta): spread between class means relative to total spread, one grouped pass."""
    if nulls not in ("drop", "zero"):
        raise ValueError("nulls must be 'drop' or 'zero'")
    def value(c: str) -> Column:
        x = finite_or_null(c)
        return F.coalesce(x, F.lit(0.0)) if nulls == "zero" else x
    cells = [F.struct(F.lit(c).alias("feature"), F.count(value(c)).alias("n"),
                      F.avg(value(c)).alias("m"), F.var_pop(value(c)).alias("v"))
             for c in features]
    per_class = (df.where(col(target).isNotNull()).groupBy(col(target).alias("class"))
                 .agg(F.array(*cells).alias("a")).select(F.explode("a").alias("r")).select("r.*")
                 .where("n > 0"))
    whole = Window.partitionBy("feature")                      # rows: one per class
    mean = F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole)
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("_mean"), F.lit(2.0)))
    within = F.sum(F.col("n") * F.col("v"))
    eta = F.sqrt(F.try_divide(between, between + within))
    return (per_class.withColumn("_mean", mean).groupBy("feature")
            .agg(F.coalesce(F.when(between == 0, F.lit(0.0)).otherwise(eta), F.lit(0.0)).alias("eta")))


def _pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, x, y, n): how often each pair of values occurs, for all requested column pairs."""
    cells = [F.struct(F.lit(p).alias("pair"), finite_or_null(a).alias("x"),
                      finite_or_null(b).alias("y")) for p, (a, b) in enumerate(pairs)]
    return materialise(
        df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
          .where(F.col("x").isNotNull() & F.col("y").isNotNull())
          .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n")), "cells")


def _margin(cells: DataFrame, side: str, limit: int | None) -> DataFrame:
    """(pair, side, total, average rank, dense code from 0) of one side of the cells."""
    m = cells.groupBy("pair", side).agg(F.sum("n").alias(f"n_{side}"))
    m = running_total(m, ["pair"], [side], "_upto", f"n_{side}", limit)
    m = running_total(m, ["pair"], [side], "_code", None, limit)
    return m.select("pair", side, f"n_{side}",
                    (F.col("_upto") - (F.col(f"n_{side}") - 1) / 2).alias(f"rank_{side}"),
                    (F.col("_code") - 1).cast("long").alias(f"code_{side}"))


def pair_associations(df: DataFrame, pairs: Sequence[tuple[str, str]],
                      limit: int | None = None) -> DataFrame:
    """(f1, f2, spearman, kendall, chi2, cramers_v) of the given column pairs.

    Rows collapse into counted value cells first. Spearman correlates the average ranks. Kendall
    (tau-b) counts discordant cells one bit of the y code at a time: two codes that share all
    higher bits are ordered by the first bit in which they differ, so a running total along x of
    the rows with that bit set finds every such pair without ever forming it.
    """
    cells = _pair_cells(df, pairs)
    mx, my = _margin(cells, "x", limit), materialise(_margin(cells, "y", limit), "margin")
    mx = materialise(mx, "margin")
    full = materialise(cells.join(mx, ["pair", "x"]).join(my, ["pair", "y"]), "cells")
    size = cells.groupBy("pair").agg(F.sum("n").alias("total"))            # one row per pair
    centred = full.join(F.broadcast(size), "pair").select(
        "pair", "n", "total", "n_x", "n_y",
        (F.col("rank_x") - (F.col("total") + 1) / 2).alias("u"),
        (F.col("rank_y") - (F.col("total") + 1) / 2).alias("v"))
    n = F.col("n").cast("double")
    stats = centred.groupBy("pair").agg(
        F.first("total").alias("total"),
        _r(F.sum(n * F.col("u") * F.col("v")), F.sum(n * F.col("u") * F.col("u")),
           F.sum(n * F.col("v") * F.col("v"))).alias("spearman"),
        (F.sum(n * n / (F.col("n_x").cast("double") * F.col("n_y"))) - 1).alias("phi2"))
    ties = None
    for m, side in ((mx, "x"), (my, "y")):
        t = F.col(f"n_{side}").cast("double")
        one = m.groupBy("pair").agg(F.sum(t * (t - 1) / 2).alias(f"tied_{side}"),
                                    F.count(F.lit(1)).alias(f"k_{side}"))
        ties = one if ties is None else ties.join(one, "pair")

    top = my.agg(F.max("code_y")).first()[0] or 0
    bits = max(int(top).bit_length(), 1)
    code = F.col("code_y")
    level = F.explode(F.array(*[
        F.struct(F.lit(b).alias("bit"), F.shiftright(code, b + 1).alias("prefix"),
                 F.shiftright(code, b).bitwiseAND(F.lit(1)).alias("one")) for b in range(bits)]))
    coded = (full.select("pair", "code_x", "n", level.alias("l"))
             .select("pair", "code_x", "n", "l.*")
             .groupBy("pair", "bit", "prefix", "code_x")
             .agg(F.sum(F.when(F.col("one") == 1, F.col("n")).otherwise(0)).alias("ones"),
                  F.sum(F.when(F.col("one") == 0, F.col("n")).otherwise(0)).alias("zeros")))
    by = ["pair", "bit", "prefix"]
    coded = running_total(coded, by, ["code_x"], "_o", "ones", limit)
    coded = running_total(coded, by, ["code_x"], "_z", "zeros", limit)
    ones, zeros = F.col("ones").cast("double"), F.col("zeros").cast("double")
    order = coded.groupBy("pair").agg(
        F.sum(zeros * (F.col("_o") - F.col("ones"))).alias("against"),
        F.sum(ones * (F.col("_z") - F.col("zeros"))).alias("along"))
    all_pairs = F.col("total").cast("double") * (F.col("total") - 1) / 2
    scale = F.sqrt(all_pairs - F.col("tied_x")) * F.sqrt(all_pairs - F.col("tied_y"))
    names = cells.sparkSession.createDataFrame(
        [(p, a, b) for p, (a, b) in enumerate(pairs)], "pair int, f1 string, f2 string")
    least = F.least(F.col("k_x"), F.col("k_y")) - 1
    return (stats.join(ties, "pair").join(order, "pair").join(names, "pair").select(
        "f1", "f2", "spearman",
        F.try_divide(F.col("along") - F.col("against"), scale).alias("kendall"),
        (F.col("phi2") * F.col("total")).alias("chi2"),
        F.sqrt(F.try_divide(F.greatest(F.col("phi2"), F.lit(0.0)), least)).alias("cramers_v")))


# ---------------------------------------------------------------- order statistics

def value_table(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """(feature, value, n, upto): counted distinct values with their running total."""
    counts = long_numbers(df, columns).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"))
    return running_total(counts, ["feature"], ["value"], "upto", "n", limit)


def quantiles_of(table: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(feature, q array): exact linear-interpolated quantiles from a ``value_table``."""
    total = table.groupBy("feature").agg(F.sum("n").alias("_t"))
    t = table.join(F.broadcast(total), "feature")              # one row per feature
    def at(place: Column) -> Column:
        here = (F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)
        return F.max(F.when(here, F.col("value")))
    out = []
    for p in probabilities:
        place = F.col("_t").cast("double") * p - p
        lo, hi = F.floor(place), F.ceil(place)
        a, b = at(lo), at(hi)
        out.append(a + (b - a) * F.max(place - lo))
    return t.groupBy("feature").agg(F.array(*out).alias("q"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    limit: int | None = None) -> DataFrame:
    return quantiles_of(value_table(df, columns, limit), probabilities)


def describe_columns(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """(feature, n, n_null, n_distinct, mean, std, min, q25, q50, q75, max) of numeric columns."""
    cells = [F.struct(F.lit(c).alias("feature"), F.count(col(c)).alias("n"),
                      F.count_if(col(c).isNull()).alias("n_null"),
                      F.avg(col(c)).cast("double").alias("mean"),
                      F.stddev_samp(col(c)).alias("std")) for c in columns]
    moments = df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    table = materialise(value_table(df, columns, limit), "values")
    shape = table.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"),
                                         F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles_of(table, [0.25, 0.5, 0.75])
    return moments.join(shape, "feature", "left").join(q, "feature", "left").select(
        "feature", "n", "n_null", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        "mean", "std", "min", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q50"),
        F.get("q", F.lit(2)).alias("q75"), "max")


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(key).limit(n)


def entropy_terms(n_xy: Column, n_x: Column, n_y: Column, n: Column) -> Column:
    """One cell's share of the mutual information of a contingency table, in nats."""
    return n_xy / n * F.ln(n_xy * n / (n_x * n_y))




def rounded_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(f.name, digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name)
                       for f in df.schema.fields])
