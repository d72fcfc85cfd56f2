"""Null rules and edge cases of row and sequence features, on small literal frames."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.expr import finite_or_null, plain_sum, null_safe_sum, safe_div
from tallyloom.operators import features, windows
from tallyloom.operators.windows import Keys, Rolling

KEYS = Keys("u", "d", "s", "id")


def log(spark, rows, extra="v long"):
    return spark.createDataFrame(rows, f"u long, d long, s long, id long, {extra}")


def values(df, name, order="id"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_null_propagates_in_sum_but_counts_zero_in_expert_sum(spark):
    df = spark.createDataFrame([(1, None, 0)], "a long, b long, c long")
    row = df.select(plain_sum(["a", "b", "c"]).alias("p"), null_safe_sum(["a", "b", "c"]).alias("z")).first()
    assert row["p"] is None and row["z"] == 1


def test_focus_loss_wins(spark):
    df = spark.createDataFrame([(1, 0, 1, 0), (0, 1, 0, 0), (None, None, None, None), (1, 0, None, None)],
                               "type_window_gained_focus int, type_entered_window int, "
                               "type_window_lost_focus int, type_left_window int")
    assert [r[0] for r in features.add_features(df, [features.window_active()]).collect()] == [0, 1, 0, 1]


def test_inputs_dropped_only_after_all_features(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, c long")
    f = [features.Feature("x", ["a", "b"], F.col("a") + F.col("b")),
         features.Feature("y", ["b", "c"], F.col("b") * F.col("c"))]
    assert features.add_features(df, f).collect()[0].asDict() == {"x": 3, "y": 6}
    assert features.add_features(df, f, replace=False).columns == ["a", "b", "c", "x", "y"]
    with pytest.raises(ValueError, match="missing"):
        features.add_features(df, [features.Feature("x", ["nope"], F.lit(1))])


def test_division_by_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 4.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [None, None, 0.25, None]
    assert [r[0] for r in df.select(safe_div("a", "b", 0)).collect()] == [0.0, 0.0, 0.25, None]


def test_infinities_become_null_and_nulls_stay(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (5.0,)], "x double")
    assert [r[0] for r in df.select(finite_or_null("x", 2.0)).collect()] == [None, None, None, None, 2.0]


def test_rolling_needs_full_window_of_known_values(spark):
    df = log(spark, [(1, 1, 1, 1, 2), (1, 1, 2, 2, 4), (2, 1, 1, 3, 1), (2, 1, 2, 4, None), (2, 1, 3, 5, 3),
                     (2, 1, 4, 6, 5), (2, 1, 5, 7, 7)])
    got = windows.rolling_features(df, [Rolling("v", "m", 3)], KEYS)
    assert values(got, "m") == [None, None, None, None, None, None, 5.0]


def test_change_flag_null_rules(spark):
    rows = [(1, 1, i, i, v) for i, v in enumerate(["A", "A", "B", None, None], 1)]
    got = windows.change_feature(log(spark, rows, "v string"), "v", "c", KEYS)
    assert values(got, "c") == [1, 0, 1, 1, 1]


def test_difference_between_marked_rows(spark):
    rows = [(1, 1, 1, 1, "v", 5), (1, 1, 2, 2, "x", 9), (1, 1, 3, 3, "v", 8)]
    df = log(spark, rows, "t string, v long")
    got = windows.marked_difference(df, F.col("t") == "v", "v", "diff", KEYS)
    assert values(got, "diff") == [None, None, 3]


def _skewed(spark, n=400):
    """One user owns most rows, with ties in (day, seq), nulls, and rare marked rows."""
    k = F.pmod(F.xxhash64("id"), F.lit(97))
    return (spark.range(n).withColumn("u", F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id") % 10))
            .withColumn("d", F.col("id") % 3).withColumn("s", F.floor(k / 20))
            .withColumn("t", F.when(k < 5, "v").otherwise("x"))
            .withColumn("v", F.when(k % 11 != 0, k)))


@pytest.mark.parametrize("limit", [20, 100])
def test_hot_user_path_equals_plain_path(spark, limit):
    df = _skewed(spark)
    specs = [Rolling("v", "m3", 3), Rolling("v", "s10", 10, "sum")]

    def run(lim):
        out = windows.rolling_features(df, specs, KEYS, lim)
        out = windows.lag_features(out, {"v": "p"}, 3, KEYS, lim)
        out = windows.change_feature(out, "t", "c", KEYS, lim)
        out = windows.marked_difference(out, F.col("t") == "v", "v", "g", KEYS, lim)
        return sorted(map(str, windows.day_progress(out, KEYS, lim).collect()))
    assert run(limit) == run(None)


def test_session_position_uses_day_maximum_over_all_users(spark):
    df = log(spark, [(1, 1, 2, 1, 0), (2, 1, 4, 2, 0), (1, 2, 5, 3, 0)])
    assert values(features.session_position(df, "d", "s"), "session_position") == [0.5, 1.0, 2.0]


def test_repartitioning_changes_nothing(spark):
    df = _skewed(spark)
    a = windows.rolling_features(df, [Rolling("v", "m", 5)], KEYS)
    b = windows.rolling_features(df.repartition(13, "v"), [Rolling("v", "m", 5)], KEYS)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
