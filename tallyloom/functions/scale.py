"""Building blocks that keep a hot key from ending up in one task.

* ``materialise`` cuts lineage through a written table in the cluster's shared folder.
* ``join_small`` broadcasts only after counting the small side.
* ``hash_rank`` and ``running_total`` are exact ``row_number`` / running ``sum`` values for groups
  of any size: a local window inside slices of the order, plus the totals of the earlier slices.
* ``split_hot`` separates the keys whose rows are too many for one window partition.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.expr import hash_key

ROWS_PER_TASK = 5_000_000      # largest group one window task may sort
BROADCAST_ROWS = 200_000       # largest counted side that is broadcast
_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where the session says
    that its one process is all there is. Written tables stay until that folder is cleared."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", None) or ""):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tallyloom-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the frame once and read it back: later passes neither recompute nor drift."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of ``new_path`` that a later one has replaced."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def store(df: DataFrame, name: str = "table") -> tuple[DataFrame, int]:
    """``materialise`` plus the number of rows, read from the footers of the written files."""
    table = materialise(df, name)
    return table, table.count()


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that must be small; more than ``limit`` rows is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left",
               limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table expected to be small: broadcast when its counted rows allow, else by shuffle
    (where adaptive execution splits skewed partitions of the big side)."""
    small, rows = store(small, "small")
    return big.join(F.broadcast(small) if rows <= limit else small, on, how)


def hash_rank(df: DataFrame, key: str, seed: int | str, by: list[str] | None = None,
              rank: str = "_rank", size: str = "_size", digits: int = 4) -> DataFrame:
    """Adds the 1-based position of each row in the md5 order of its group and the group size.

    Rows are windowed inside (group, leading hex digits); the rows of the earlier slices are
    counted beforehand. One shuffle on (group, slice) serves both the join and the window.
    ``key`` must be unique and ``by`` not null.
    """
    by = list(by or [])
    hashed = (df.withColumn("_h", hash_key(key, seed))
                .withColumn("_slice", F.substring("_h", 1, digits)))
    counts = hashed.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_slice",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias(size))
    inside = Window.partitionBy(*by, "_slice").orderBy("_h", key)
    return (hashed.join(offsets, [*by, "_slice"])
                  .withColumn(rank, F.row_number().over(inside) + F.col("_before"))
                  .drop("_h", "_slice", "_before"))


def _largest_group(df: DataFrame, by: list[str]) -> int:
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def running_total(df: DataFrame, by: list[str], order: list, name: str = "_upto",
                  weight: str | None = None, limit: int | None = None,
                  stored: bool = False) -> DataFrame:
    """Adds the inclusive running total of ``weight`` (default: 1 per row) in ``order`` per group.

    ``order`` must be a total order inside the group. Groups up to ``limit`` rows use one window;
    beyond it the frame is range-partitioned on (group, order), so that even a single group is
    spread over all tasks, and each range adds the totals of the ranges before it.
    """
    limit = ROWS_PER_TASK if limit is None else limit
    df = df if stored else materialise(df, "ordered")
    amount = F.lit(1) if weight is None else F.col(weight)
    if _largest_group(df, by) <= limit:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(amount).over(w))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_TASK))
    ranged = materialise(df.repartitionByRange(parts, *by, *order)
                           .withColumn("_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*by, "_range").agg(F.sum(amount).alias("_t"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_range",
                           F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    inside = (Window.partitionBy(*by, "_range").orderBy(*order)
                    .rowsBetween(Window.unboundedPreceding, 0))
    return (ranged.join(before, [*by, "_range"])
                  .withColumn(name, F.sum(amount).over(inside) + F.col("_before"))
                  .drop("_range", "_before"))


def split_hot(df: DataFrame, key: str, limit: int | None = None
              ) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of keys with more than ``limit`` rows or None)."""
    limit = ROWS_PER_TASK if limit is None else limit
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot, n = store(counts.where(F.col("_n") > limit).select(key), "hot")
    if n == 0:
        return df, None
    hot = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    same = df[key].eqNullSafe(hot[key])
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")
