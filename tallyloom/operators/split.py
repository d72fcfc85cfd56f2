"""Splits and folds as a column, ranked by md5 so that they do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.expr import col, hash_key, safe_div
from tallyloom.functions.scale import hash_rank, join_small, running_total


def _check(test_size: float, val_size: float | None) -> float:
    val = val_size or 0.0
    if not 0 < test_size < 1 or (val_size is not None and not 0 < val_size < 1):
        raise ValueError("split sizes must lie between 0 and 1")
    if test_size + val >= 1:
        raise ValueError("nothing left for training")
    return val


def _split_by_rank(rank: Column, size: Column, test: float, val: float) -> Column:
    n_test, n_val = F.round(size * test), F.round(size * val)
    return (F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "val")
             .otherwise("train"))


def split_by_groups(df: DataFrame, group: str, test_size: float = 0.2,
                    val_size: float | None = None, seed: int = 42) -> DataFrame:
    """Adds ``split``: whole groups go to test, validation or train by their md5 rank.

    Rows without a group are left out, as every split leaves out rows it cannot place.
    """
    val = _check(test_size, val_size)
    groups = df.where(col(group).isNotNull()).select(group).distinct()
    ranked = hash_rank(groups, group, seed)
    assigned = ranked.select(group, _split_by_rank(
        F.col("_rank"), F.col("_size"), test_size, val).alias("split"))
    return join_small(df, assigned, [group], "inner")


def split_by_target(df: DataFrame, target: str, key: str, test_size: float = 0.2,
                    val_size: float | None = None, seed: int = 42) -> DataFrame:
    """Adds ``split``: every class gives its share of rows to test and validation."""
    val = _check(test_size, val_size)
    ranked = hash_rank(df.where(col(target).isNotNull()), key, seed, [target])
    return ranked.withColumn("split", _split_by_rank(
        F.col("_rank"), F.col("_size"), test_size, val)).drop("_rank", "_size")


def group_folds(df: DataFrame, group: str, target: str, k: int = 20, seed: int = 42,
                limit: int | None = None) -> DataFrame:
    """(group, fold): whole groups, with each class spread over the folds.

    Groups are sorted by size within their dominant class and dealt in serpentine order; the deal
    starts at a different fold for each class.
    """
    counts = (df.where(col(group).isNotNull() & col(target).isNotNull())
                .groupBy(group, target).agg(F.count(F.lit(1)).alias("n")))
    groups = counts.groupBy(group).agg(
        F.min_by(col(target), F.struct(-F.col("n"), col(target))).alias("_class"),
        F.sum("n").alias("_size")).withColumn("_h", hash_key(group, seed))
    dealt = running_total(groups, ["_class"], [F.col("_size").desc(), F.col("_h"), F.col(group)],
                          "_place", limit=limit)
    turn = dealt.select("_class").distinct().select(          # one row per class
        "_class", (F.row_number().over(Window.partitionBy().orderBy("_class")) - 1).alias("_turn"))
    place = F.col("_place") - 1
    seat = place % k
    straight = F.floor(place / k) % 2 == 0
    fold = (F.when(straight, seat).otherwise(k - 1 - seat) + F.col("_turn")) % k
    return dealt.join(turn, "_class").select(group, fold.cast("int").alias("fold"))


FOLD_COUNTS = (20, 50, 100, 200, 1000)   # finer folds only for shares that coarser ones miss


def fold_shares(test: float, val: float, k: int | None = None) -> tuple[int, int, int]:
    """(k, test folds, validation folds): at least one fold for every wanted part and for training,
    with the fewest folds that come within 1/40 of both shares."""
    for n in (k,) if k else FOLD_COUNTS:
        n_test, n_val = max(round(test * n), 1), max(round(val * n), 1) if val else 0
        close = abs(n_test / n - test) <= 0.025 and abs(n_val / n - val) <= 0.025
        if n_test + n_val < n and (close or k):
            return n, n_test, n_val
    raise ValueError("the shares leave no fold for training")


def split_by_groups_and_target(df: DataFrame, group: str, target: str, test_size: float = 0.2,
                               val_size: float | None = None, seed: int = 42, k: int | None = None,
                               limit: int | None = None) -> DataFrame:
    """Adds ``split``: whole groups, classes balanced, by giving whole folds to each split.

    Rows of groups without any label, and rows without a group, are left out.
    """
    k, n_test, n_val = fold_shares(test_size, _check(test_size, val_size), k)
    fold = F.col("fold")
    assigned = group_folds(df, group, target, k, seed, limit).select(group, (
        F.when(fold < n_test, "test").when(fold < n_test + n_val, "val")
         .otherwise("train")).alias("split"))
    return join_small(df, assigned, [group], "inner")


def stratified_folds(df: DataFrame, target: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..k-1; every class is spread evenly."""
    ranked = hash_rank(df.where(col(target).isNotNull()), key, seed, [target])
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_size")


def whole_group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42,
                      limit: int | None = None) -> DataFrame:
    """Adds ``fold`` in 0..k-1; groups stay whole and are dealt by size in serpentine order."""
    sizes = (df.where(col(group).isNotNull()).groupBy(group)
               .agg(F.count(F.lit(1)).alias("_size")).withColumn("_h", hash_key(group, seed)))
    dealt = running_total(sizes, [], [F.col("_size").desc(), F.col("_h"), F.col(group)], "_place",
                          limit=limit)
    place = F.col("_place") - 1
    seat = place % k
    fold = F.when(F.floor(place / k) % 2 == 0, seat).otherwise(k - 1 - seat)
    return join_small(df, dealt.select(group, fold.cast("int").alias("fold")), [group])


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Exactly round(fraction * rows) rows, those first in md5 order."""
    ranked = hash_rank(df, key, seed)
    return ranked.where(F.col("_rank") <= F.round(F.col("_size") * fraction)).drop("_rank", "_size")


# ---------------------------------------------------------------- checks

SPLITS = ["train", "val", "test"]


def split_distribution(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """(split, class, n, share): class shares inside each split."""
    counts = df.groupBy(split, col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", safe_div(
        F.col("n"), F.sum("n").over(Window.partitionBy(split))))


def group_presence(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """One row per group with a 0/1 flag for each split it occurs in."""
    return df.groupBy(group).agg(*[
        F.max(F.when(col(split) == s, 1).otherwise(0)).alias(s) for s in SPLITS])


def group_overlaps(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """(kind, n): groups per split and groups shared by each two splits."""
    seen = group_presence(df, group, split)
    cells = {"train": F.col("train"), "val": F.col("val"), "test": F.col("test"),
             "train&val": F.col("train") * F.col("val"),
             "train&test": F.col("train") * F.col("test"),
             "val&test": F.col("val") * F.col("test")}
    one = seen.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in cells.items()])
    return one.unpivot([], list(cells), "kind", "n")


def shared_groups(df: DataFrame, group: str, a: str, b: str, split: str = "split") -> DataFrame:
    """The group values that occur in both splits."""
    return (df.where(col(split) == a).select(group)
              .intersect(df.where(col(split) == b).select(group)))


def groups_only_in(df: DataFrame, group: str, a: str, b: str, split: str = "split") -> DataFrame:
    return (df.where(col(split) == a).select(group)
              .subtract(df.where(col(split) == b).select(group)))


def shares_by_split(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """(class, train, val, test): class shares side by side, 0 where absent."""
    counts = df.groupBy(col(target).alias("class")).agg(*[
        F.count_if(col(split) == s).alias(s) for s in SPLITS], F.count(F.lit(1)).alias("all"))
    everything = Window.partitionBy()                          # one row per class
    return counts.select("class", *[
        F.coalesce(safe_div(F.col(s), F.sum(s).over(everything)), F.lit(0.0)).alias(s)
        for s in (*SPLITS, "all")])


def share_drift(df: DataFrame, target: str, tolerance: float = 0.15,
                split: str = "split") -> DataFrame:
    """Class shares of validation and test against train, flagged from ``tolerance`` on."""
    s = shares_by_split(df, target, split).where("train > 0")
    dv, dt = F.abs(F.col("train") - F.col("val")), F.abs(F.col("train") - F.col("test"))
    return s.select("class", "train", "val", "test", (dv >= tolerance).alias("val_flag"),
                    (dt >= tolerance).alias("test_flag"))


def stratification_check(df: DataFrame, target: str, tolerance: float = 0.05,
                         split: str = "split") -> DataFrame:
    """One row: largest share difference to the whole per split, sizes, and the alert.

    The validation difference is reported but does not raise the alert.
    """
    counts = df.groupBy(col(target).alias("class")).agg(*[
        F.count_if(col(split) == s).alias(s) for s in SPLITS], F.count(F.lit(1)).alias("all"))
    everything = Window.partitionBy()                          # one row per class
    share = {s: F.coalesce(safe_div(F.col(s), F.sum(s).over(everything)), F.lit(0.0))
             for s in (*SPLITS, "all")}
    one = counts.select(*SPLITS, *[F.abs(share["all"] - share[s]).alias(f"_{s}") for s in SPLITS]
        ).agg(*[F.max(f"_{s}").alias(f"max_diff_{s}") for s in SPLITS],
              *[F.sum(s).alias(f"n_{s}") for s in SPLITS])
    alert = (F.col("max_diff_train") > tolerance) | (F.col("max_diff_test") > tolerance)
    return one.withColumn("alert", alert)


def split_report(df: DataFrame, target: str, group: str | None = None,
                 split: str = "split") -> DataFrame:
    """Class shares per split; with a group column also the overlap counts."""
    shares = split_distribution(df, target, split).select(
        F.concat_ws(":", F.lit("share"), col(split), F.col("class").cast("string")).alias("item"),
        F.col("share").alias("value"))
    if group is None:
        return shares
    overlap = group_overlaps(df, group, split).where(F.col("kind").contains("&"))
    return shares.unionByName(overlap.select(
        F.concat_ws(":", F.lit("overlap"), "kind").alias("item"),
        F.col("n").cast("double").alias("value")))
