"""Per-user sequence features: lags, rolling means and sums, changes, positions.

All features of one call share a single window order, so ordinary users cost one shuffle and
sort. A user with more rows than one task should sort is cut into ranges of the order; each range
receives copies of the few rows before it that lags and rolling frames can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyloom.functions.expr import flag, safe_div
from tallyloom.functions.scale import ROWS_PER_TASK, join_small, materialise, split_hot
from tallyloom.operators.features import (
    add_features, clean_numeric, equation_progress, step_verifications, time_efficiency,
)


@dataclass(frozen=True)
class Keys:
    """Names of the columns that place a row in its user's history."""
    user: str = "aluno"
    day: str = "num_dia"
    seq: str = "num_log"
    row: str = "id_log"

    @property
    def order(self) -> list[str]:
        return [self.day, self.seq, self.row]


@dataclass(frozen=True)
class Rolling:
    """Mean or sum of the last ``size`` rows; null until that many non-null values are seen."""
    source: str
    name: str
    size: int
    kind: str = "avg"

    def over(self, w: WindowSpec) -> Column:
        frame = w.rowsBetween(-(self.size - 1), 0)
        value = F.avg(self.source) if self.kind == "avg" else F.sum(self.source)
        return F.when(F.count(self.source).over(frame) == self.size, value.over(frame))


def sequence_order(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Global sort by user, day, log number and row key."""
    return df.orderBy(keys.user, *keys.order)


def over_sequences(df: DataFrame, keys: Keys, lookback: int,
                   build: Callable[[DataFrame, WindowSpec], DataFrame],
                   mark: Column | None = None, limit: int | None = None) -> DataFrame:
    """Apply ``build(frame, window)`` to every user's history.

    ``build`` may look back ``lookback`` rows and, when ``mark`` is given, to the latest earlier
    row for which ``mark`` holds, however far back that is.
    """
    cold, hot = split_hot(df, keys.user, limit)
    whole = Window.partitionBy(keys.user).orderBy(*keys.order)
    out = build(cold, whole)
    if hot is None:
        return out
    frame = _with_halo(hot, keys, lookback, mark)
    inside = Window.partitionBy(keys.user, "_part").orderBy(*keys.order)
    done = build(frame, inside).where(~F.col("_halo")).drop("_part", "_halo")
    return out.unionByName(done)


def _with_halo(hot: DataFrame, keys: Keys, lookback: int, mark: Column | None) -> DataFrame:
    """Cut hot users into ranges of their order and prepend to each the rows it looks back to."""
    columns = hot.columns
    parts = max(int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hot.count() // ROWS_PER_TASK))
    ranged = materialise(
        hot.repartitionByRange(parts, keys.user, *keys.order)
           .withColumn("_part", F.spark_partition_id()), "history")
    place = F.struct(*[F.col(c) for c in keys.order])
    packed_row = F.struct(place.alias("place"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    reach = max(lookback, 1)
    newest = (Window.partitionBy(keys.user, "_part")
                    .orderBy(*[F.col(c).desc() for c in keys.order]))
    tails = (ranged.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= reach)
                   .groupBy(keys.user, "_part")
                   .agg(F.sort_array(F.collect_list(packed_row)).alias("tail")))
    if mark is None:
        marks = tails.select(keys.user, "_part", F.lit(None).cast(
            tails.schema["tail"].dataType.elementType).alias("marked"))
    else:
        marks = ranged.groupBy(keys.user, "_part").agg(
            F.max(F.when(flag(mark) == 1, packed_row)).alias("marked"))
    by_part = Window.partitionBy(keys.user).orderBy("_part")
    near = by_part.rowsBetween(-reach, -1)
    far = by_part.rowsBetween(Window.unboundedPreceding, -1)
    carried = (tails.join(marks, [keys.user, "_part"])
        .select(keys.user, "_part",
                F.flatten(F.collect_list("tail").over(near)).alias("near"),
                F.last("marked", ignorenulls=True).over(far).alias("marked"))
        .where(F.size("near") > 0)
        .withColumn("near", F.slice("near", F.greatest(F.size("near") - reach + 1, F.lit(1)),
                                    F.lit(reach)))
        .withColumn("halo", F.when(
            F.col("marked").isNotNull()
            & (F.col("marked.place") < F.element_at("near", 1).getField("place")),
            F.concat(F.array("marked"), F.col("near"))).otherwise(F.col("near"))))
    halo = (carried.select("_part", F.explode("halo").alias("h"))
                   .select("h.row.*", "_part", F.lit(True).alias("_halo")))
    return ranged.withColumn("_halo", F.lit(False)).unionByName(halo)


def lags(df: DataFrame, source: str, prefix: str, n: int, w: WindowSpec) -> DataFrame:
    return df.withColumns({f"{prefix}_{i}": F.lag(source, i).over(w) for i in range(1, n + 1)})


def changed(source: str, w: WindowSpec) -> Column:
    """1 unless the previous value is known and equal: first rows and null pairs count as changes."""
    return 1 - flag(F.lag(source).over(w) == F.col(source))


def since_marked(mark: Column, source: str, w: WindowSpec) -> Column:
    """On marked rows: the value minus that of the previous marked row; null elsewhere."""
    before = F.last(F.when(mark, F.struct(F.col(source).alias("v"))), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(mark, F.col(source) - before.getField("v"))


def lag_features(df: DataFrame, sources: dict[str, str], n: int = 3, keys: Keys = Keys(),
                 limit: int | None = None) -> DataFrame:
    """``{column: prefix}`` -> ``prefix_1 .. prefix_n``, the values of the previous rows."""
    def build(frame, w):
        for source, prefix in sources.items():
            frame = lags(frame, source, prefix, n, w)
        return frame
    return over_sequences(df, keys, n, build, limit=limit)


def lag_equals(df: DataFrame, source: str, literal: str, prefix: str, n: int = 3,
               keys: Keys = Keys(), limit: int | None = None) -> DataFrame:
    """``prefix_i`` = 1 where the value i rows earlier equals the literal, else 0."""
    def build(frame, w):
        return frame.withColumns({f"{prefix}_{i}": flag(F.lag(source, i).over(w) == literal)
                                  for i in range(1, n + 1)})
    return over_sequences(df, keys, n, build, limit=limit)


def rolling_features(df: DataFrame, specs: Sequence[Rolling], keys: Keys = Keys(),
                     limit: int | None = None) -> DataFrame:
    reach = max(s.size for s in specs) - 1
    return over_sequences(df, keys, reach, lambda frame, w: frame.withColumns(
        {s.name: s.over(w) for s in specs}), limit=limit)


def change_feature(df: DataFrame, source: str, name: str, keys: Keys = Keys(),
                   limit: int | None = None) -> DataFrame:
    return over_sequences(df, keys, 1, lambda frame, w: frame.withColumn(
        name, changed(source, w)), limit=limit)


def marked_difference(df: DataFrame, mark: Column, source: str, name: str, keys: Keys = Keys(),
                      limit: int | None = None) -> DataFrame:
    known = F.coalesce(mark, F.lit(False))
    return over_sequences(df, keys, 1, lambda frame, w: frame.withColumn(
        name, since_marked(known, source, w)), mark=known, limit=limit)


def day_progress(df: DataFrame, keys: Keys = Keys(), limit: int | None = None) -> DataFrame:
    """``steps_in_equation``, ``step_position`` and ``relative_position`` within a user's day."""
    def finish(frame: DataFrame, steps: Column, first: Column) -> DataFrame:
        return (frame.withColumn("steps_in_equation", steps)
                     .withColumn("step_position", F.col(keys.seq) - first + 1)
                     .withColumn("relative_position",
                                 safe_div("step_position", "steps_in_equation")))
    cold, hot = split_hot(df, keys.user, limit)
    w = Window.partitionBy(keys.user, keys.day)
    out = finish(cold, F.count(keys.seq).over(w), F.min(keys.seq).over(w))
    if hot is None:
        return out
    days = hot.groupBy(keys.user, keys.day).agg(F.count(keys.seq).alias("_steps"),
                                                F.min(keys.seq).alias("_first"))
    joined = finish(join_small(hot, days, [keys.user, keys.day]),
                    F.col("_steps"), F.col("_first"))
    return out.unionByName(joined.drop("_steps", "_first"))


def temporal_features(df: DataFrame, sequence_windows: Sequence[int] = (3, 5, 10),
                      include_last_n_steps: int = 3, keys: Keys = Keys(),
                      literal: str = "step_verification", clean: bool = True,
                      limit: int | None = None) -> DataFrame:
    """Every temporal feature at once: one window order for lags, rolling frames and changes."""
    n = include_last_n_steps
    specs = [spec for k in sequence_windows for spec in (
        Rolling("ultimo_passo_correto", f"success_rate_{k}", k),
        Rolling("tempo_passo", f"avg_step_time_{k}", k),
        Rolling("idle_time_acumulado", f"idle_time_sum_{k}", k, "sum"),
        Rolling("num_click_acumulado", f"clicks_sum_{k}", k, "sum"),
        Rolling("step_verifications", f"verification_rate_{k}", k))]
    mark = F.col("step_verifications") == 1

    def build(frame: DataFrame, w: WindowSpec) -> DataFrame:
        made: dict[str, Column] = {}
        for i in range(1, n + 1):
            made[f"prev_step_correct_{i}"] = F.lag("ultimo_passo_correto", i).over(w)
            made[f"prev_log_type_{i}"] = F.lag("log_type", i).over(w)
            made[f"prev_eq_step_verification_{i}"] = flag(F.lag("log_type", i).over(w) == literal)
        made.update({s.name: s.over(w) for s in specs})
        made["behavior_changed"] = changed("comportamento", w)
        made["time_between_verifications"] = since_marked(mark, "tempo_passo", w)
        return frame.withColumns(made)

    base = add_features(df, [step_verifications(literal)], replace=False)
    reach = max([n, *[k - 1 for k in sequence_windows]])
    out = over_sequences(base, keys, reach, build, mark=mark, limit=limit)
    out = day_progress(out, keys, limit)
    out = add_features(out, [*time_efficiency(), *equation_progress()], replace=False)
    return clean_numeric(out) if clean else out
