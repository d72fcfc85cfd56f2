"""Helpers shared by the operators on vectors."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def finite(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite components; false for null."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))),
                      F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of ``dims`` doubles; a vector of another length is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets))
    if (lengths != dims).any():
        raise ValueError(f"vectors of {dims} components expected, found {sorted(set(lengths.tolist()))[:5]}")
    return np.asarray(column.flatten()).astype(float).reshape(len(column), dims)
