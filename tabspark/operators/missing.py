"""Missing cells: tests, dropping and filling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import SchemaError
from tabspark.operators.columns import require
from tabspark.session import quoted


def is_missing(name: str) -> Column:
    return quoted(name).isNull()


def drop_incomplete(df: DataFrame, *names: str) -> DataFrame:
    """Rows that have all of the named columns, or all columns."""
    return df.dropna("any", subset=list(names) or None)


def present(df: DataFrame, name: str) -> DataFrame:
    """One column without its missing cells."""
    require(df, name)
    return df.select(quoted(name)).where(quoted(name).isNotNull())


def fill(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing cells of some columns replaced by the columns' defaults, cast to their types."""
    require(df, *defaults)
    filled = lambda n: F.coalesce(quoted(n), F.lit(defaults[n]).cast(df.schema[n].dataType)).alias(n)
    return df.select(*[filled(n) if n in defaults else quoted(n) for n in df.columns])


def map_cells(df: DataFrame, there: Callable[[Column], Column], gone: Column | None = None) -> DataFrame:
    """The same function on every cell that is there, and ``gone`` (null by default) in the place of every missing one."""
    return df.select(*[F.when(quoted(c).isNotNull(), there(quoted(c))).otherwise(F.lit(None) if gone is None else gone).alias(c) for c in df.columns])


def zip_cells(df: DataFrame, first: str, second: str, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Two struct columns of the same fields as one row: each cell is a function of both records' cells, missing ones too."""
    require(df, first, second, kind=T.StructType)
    fields = df.schema[first].dataType.fields
    if [(f.name, f.dataType) for f in fields] != [(f.name, f.dataType) for f in df.schema[second].dataType.fields]:
        raise SchemaError(f"{first!r} and {second!r} have different fields")
    return df.select(*[combine(quoted(first).getField(f.name), quoted(second).getField(f.name)).alias(f.name) for f in fields])


def contains_word(name: str, word: str) -> Column:
    """Whether a text holds a word, whatever the case."""
    return F.lower(quoted(name)).contains(word.lower())
