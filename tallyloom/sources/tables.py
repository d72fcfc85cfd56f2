"""Readers of log tables and feature matrices."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.scale import bounded_rows

# Type names of a column catalogue.
CATALOGUE_TYPES = {"int64": T.LongType(), "float64": T.DoubleType(), "object": T.StringType()}


def read_catalogue(spark: SparkSession, path: str, delimiter: str = ";") -> T.StructType:
    """A ``name;dtype`` file as a schema, in file order."""
    lines = spark.read.schema("value string").text(path, wholetext=True)
    text = "\n".join(r[0] for r in bounded_rows(lines, 1000, "catalogue files"))
    fields = []
    for line in text.splitlines()[1:]:
        if line.strip():
            name, kind = [part.strip() for part in line.split(delimiter)[:2]]
            if kind not in CATALOGUE_TYPES:
                raise ValueError(f"unknown type {kind!r} of column {name!r}")
            fields.append(T.StructField(name, CATALOGUE_TYPES[kind]))
    return T.StructType(fields)


def catalogue_text(df: DataFrame, delimiter: str = ";") -> str:
    """The catalogue of a frame whose columns have catalogue types."""
    names = {type(t): n for n, t in CATALOGUE_TYPES.items()}
    return "\n".join([f"name{delimiter}dtype", *[
        f"{f.name}{delimiter}{names[type(f.dataType)]}" for f in df.schema.fields]]) + "\n"


def load_data(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header; give a schema to spare the extra pass that infers one."""
    reader = (spark.read.option("header", True).option("sep", delimiter)
              .option("encoding", encoding).option("mode", "FAILFAST"))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def load_matrix(spark: SparkSession, path: str, key: str, array: str, label: str) -> DataFrame:
    """Labelled feature matrix from Parquet: (row_id, features vector, label)."""
    return spark.read.parquet(path).select(
        F.col(key).alias("row_id"),
        array_to_vector(F.col(array).cast("array<double>")).alias("features"),
        F.col(label).cast("int").alias("label"))
