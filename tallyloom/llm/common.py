"""Column helpers and exact ranks shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scale import BROADCAST_ROWS, store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BREAK = r"[\x20\x09-\x0D]+"
SLICES = 4096   # slices of one group's order; a window holds one slice


def text_of(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between ASCII white space; an empty array without any."""
    return F.array_remove(F.split(text_of(text), BREAK, -1), "")


def id_text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds a number from 1 on to rows that agree in all ``keys``; rows that agree must be interchangeable.

    Only the repeated ones meet in windows; the others, usually all, do not move.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again, n = store(counts.select(*[F.col(k).alias(f"_{k}") for k in keys]), "repeated")
    if not n:
        return df.withColumn(name, F.lit(1))
    same = [df[k].eqNullSafe(again[f"_{k}"]) for k in keys]
    side = F.broadcast(again) if n <= BROADCAST_ROWS else again
    window = Window.partitionBy(*keys).orderBy(F.lit(1))
    return (df.join(side, same, "left_semi").withColumn(name, F.row_number().over(window))
              .unionByName(df.join(side, same, "left_anti").withColumn(name, F.lit(1))))


def hex_unit(digest: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits, exact in a double."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(16 ** 13))


def rows_packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns in one struct, so that own column names never clash with the table's."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))


def sliced_rank(df: DataFrame, by: list[str], digest: str, ties: list[str],
                rank: str = "rank") -> DataFrame:
    """0-based gapless rank of each row of its group, in the order of (``digest``, ``ties``).

    ``digest`` is a hex text. A window task holds one of 4096 slices of a group's order; the rows of
    earlier slices come from a table of at most 4096 counts per group, so a group with a third of
    all rows is still spread over thousands of windows, provided that the digest covers what tells its rows apart: an
    id alone may be null or repeated. Rows equal in ``ties`` too must be interchangeable. ``by`` must not be null and has a bounded number of values (shards, bins).
    """
    df = df.withColumn("_slice", F.substring(digest, 1, 3))
    counts = df.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*by).orderBy("_slice")
                    .rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*by, "_slice",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_slice").orderBy(digest, *ties)
    ranked = df.withColumn("_at", F.row_number().over(inside))
    return (ranked.join(starts, [*by, "_slice"])
                  .withColumn(rank, F.col("_start") + F.col("_at") - 1)
                  .drop("_slice", "_start", "_at"))


def trim() -> None:
    """Give freed memory back to the system: a Python worker outlives its task and keeps what it once needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):      # another C library
        pass
