"""Row and column cleaning: drops, label merges, required columns, multicollinearity pruning."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.expr import col
from tallyloom.functions.scale import bounded_rows, materialise


def remove_columns(df: DataFrame, columns_to_remove: Sequence[str] | None,
                   columns_to_keep: Sequence[str] | None = None) -> DataFrame:
    """Drop the listed columns except those on the keep list; unknown names only warn."""
    if columns_to_remove is None:
        raise ValueError("columns_to_remove must be given")
    wanted = [c for c in columns_to_remove if c not in set(columns_to_keep or [])]
    unknown = sorted(set(wanted) - set(df.columns))
    if unknown:
        warnings.warn(f"columns not found, ignored: {unknown}", stacklevel=2)
    return df.drop(*[c for c in wanted if c in df.columns])


def remove_instances_with_value(df: DataFrame, column: str, value) -> DataFrame:
    """Drop rows equal to the value. Null rows stay; a missing column changes nothing."""
    if column not in df.columns:
        return df
    return df.where(~col(column).eqNullSafe(F.lit(value)))


def keep_labelled(df: DataFrame, column: str) -> DataFrame:
    return df.where(col(column).isNotNull())


def merge_values(column: str, values: Sequence, into) -> Column:
    """The listed values become ``into``, everything else stays."""
    return F.when(col(column).isin(list(values)), F.lit(into)).otherwise(col(column))


def merge_by_map(column: str, mapping: Mapping) -> Column:
    out = col(column)
    for old, new in mapping.items():
        out = F.when(col(column) == F.lit(old), F.lit(new)).otherwise(out)
    return out


def columns_of_type(df: DataFrame, kind: str = "number") -> list[str]:
    """Column names by type: 'number', 'double' or 'other' (non-numeric)."""
    def wanted(t: T.DataType) -> bool:
        numeric = isinstance(t, T.NumericType)
        return {"number": numeric, "double": isinstance(t, T.DoubleType), "other": not numeric}[kind]
    return [f.name for f in df.schema.fields if wanted(f.dataType)]


def columns_by_regex(df: DataFrame, pattern: str) -> list[str] | None:
    found = [c for c in df.columns if re.search(pattern, c)]
    return found or None


def with_target(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features as one vector beside the label; both sides stay in the same frame."""
    from pyspark.ml.feature import VectorAssembler
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return asm.transform(df.select(*features, col(target).alias("label")))


def sequence_key(day: str, seq: str) -> Column:
    return F.col(day) * 1000 + F.col(seq)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_null) for the listed columns in one pass."""
    if not columns:
        raise ValueError("no columns given")
    one = df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "n_null")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise if a column is missing or holds nulls, naming the counts; else return the frame."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    found = bounded_rows(null_counts(df, columns).where("n_null > 0"), len(columns), "null counts")
    if found:
        raise ValueError(f"nulls in required columns: {({r['column']: r['n_null'] for r in found})}")
    return df


def drop_candidates(pairs: DataFrame, strength: DataFrame, threshold: float = 0.90,
                    keep: str = "higher") -> DataFrame:
    """From each pair with |r| > threshold, the feature to drop.

    ``pairs`` is (i, f1, j, f2, r) with i < j; ``strength`` is (feature, strength). ``keep='higher'``
    keeps the feature closer to the target, ``'lower'`` drops exactly that one instead.
    On equal strength ``'higher'`` drops the first, ``'lower'`` the second of the pair.
    """
    if keep not in ("higher", "lower"):
        raise ValueError("keep must be 'higher' or 'lower'")
    s = strength.select("feature", "strength")
    joined = (pairs.where(F.abs("r") > threshold)
              .join(s.withColumnsRenamed({"feature": "f1", "strength": "s1"}), "f1", "left")
              .join(s.withColumnsRenamed({"feature": "f2", "strength": "s2"}), "f2", "left"))
    first_wins = F.coalesce(F.col("s1") > F.col("s2"), F.lit(False))
    drop = (F.when(first_wins, F.col("f2")).otherwise(F.col("f1")) if keep == "higher"
            else F.when(first_wins, F.col("f1")).otherwise(F.col("f2")))
    return joined.select(drop.alias("feature")).distinct()


def highly_correlated(df: DataFrame, target: str, threshold: float = 0.90,
                      keep: str = "higher", nulls: str = "drop") -> DataFrame:
    """Features to drop, judged by correlation ratio to a categorical target."""
    from tallyloom.operators.profile import correlation_pairs, correlation_ratio
    features = [c for c in columns_of_type(df) if c != target]
    pairs = correlation_pairs(df, features)
    eta = correlation_ratio(df, target, features, nulls).withColumnRenamed("eta", "strength")
    return drop_candidates(pairs, eta, threshold, keep)


def highly_correlated_to_numeric(df: DataFrame, target: str, threshold: float = 0.90) -> DataFrame:
    """Features to drop, judged by |Pearson r| to a numeric target; a tie drops the first."""
    from tallyloom.operators.profile import correlation_pairs
    features = [c for c in columns_of_type(df) if c != target]
    pairs = correlation_pairs(df, [*features, target])
    to_target = pairs.where(F.col("f2") == target).select(
        F.col("f1").alias("feature"), F.abs("r").alias("strength"))
    return drop_candidates(pairs.where(F.col("f2") != target), to_target, threshold, "higher")


def remove_highly_correlated(df: DataFrame, drops: DataFrame) -> DataFrame:
    names = [r[0] for r in bounded_rows(drops, len(df.columns), "columns to drop")]
    return df.drop(*names)


def clean_data(df: DataFrame, target_column: str, undefined_value: str = "?",
               columns_to_remove: Sequence[str] = (), columns_to_keep: Sequence[str] | None = None,
               handle_multicollinearity: bool = False, threshold: float = 0.90,
               keep: str = "higher") -> DataFrame:
    """Undefined labels out, listed columns out, optionally correlated columns out."""
    out = remove_instances_with_value(df, target_column, undefined_value)
    out = remove_columns(out, columns_to_remove, columns_to_keep)
    if handle_multicollinearity:
        out = materialise(out, "clean")        # read by every pass over the features
        drops = highly_correlated(out, target_column, threshold, keep)
        names = [r[0] for r in bounded_rows(drops, len(out.columns), "columns to drop")]
        out = remove_columns(out, names, columns_to_keep)
    return out
