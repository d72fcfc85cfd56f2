"""Column helpers shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def safe_div(a: str | Column, b: str | Column, fill: float | None = None) -> Column:
    """a / b, or ``fill`` where b is zero. A null on either side stays null."""
    num, den = col(a).cast("double"), col(b).cast("double")
    if fill is None:
        return F.try_divide(num, den)
    return F.when(den == 0, F.lit(float(fill))).otherwise(F.try_divide(num, den))


def null_safe_sum(cols: list[str]) -> Column:
    """Row-wise sum in which a null counts as zero."""
    return reduce(add, [F.coalesce(col(c), F.lit(0)) for c in cols])


def plain_sum(cols: list[str]) -> Column:
    """Row-wise sum in which a null makes the whole sum null."""
    return reduce(add, [col(c) for c in cols])


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def finite_or_null(c: str | Column, bound: float = 1e308) -> Column:
    """Infinities and NaN become null; what remains is clipped to [-bound, bound]."""
    x = col(c).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(~bad, F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)))


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Round and fold -0.0 into 0.0, so that equal results print equally."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def percent_text(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)


def hash_key(key: str | Column, seed: int | str) -> Column:
    """md5 of '<key>-<seed>': a shuffle order that does not depend on partitioning."""
    return F.md5(F.concat(col(key).cast("string"), F.lit(f"-{seed}")))


def unit_interval(h: Column) -> Column:
    """The first 32 bits of an md5 text as a double in [0, 1)."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
