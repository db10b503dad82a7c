"""DataFrames from values in the program."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabspark.sources.infer import TableSpec


def to_frame(spark: SparkSession, rows: Iterable, spec: TableSpec | T.StructType | str) -> DataFrame:
    """Rows of the given columns."""
    return spark.createDataFrame(list(rows), spec.schema if isinstance(spec, TableSpec) else spec)


def boxed_frame(spark: SparkSession, values: Iterable, kind: str, name: str = "value") -> DataFrame:
    """Any values of one Spark type, one a row."""
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(name, T._parse_datatype_string(kind))]))


def empty_frame(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
