"""Wide to long: each row becomes as many rows as it has value columns, with a tagged value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.errors import SchemaError
from tabspark.operators.columns import require
from tabspark.operators.tagged import variants_of
from tabspark.session import quoted


def _values(df: DataFrame, ids: list[str]) -> list[str]:
    require(df, *ids)
    values = [c for c in df.columns if c not in ids]
    if not values:
        raise SchemaError("no value column is left")
    return values


def row_to_column(df: DataFrame, names: list[str]) -> Column:
    """The named columns of a row as an array of tagged values, in this order."""
    kinds = variants_of(df.schema, names)
    return F.array(*[kinds.make(n, quoted(n)) for n in names])


def melt(df: DataFrame, ids: list[str], value: str = "value", value_first: bool = False) -> DataFrame:
    """One row for each row and column that is no id: the ids, and the tagged value after (or before) them. No row moves."""
    values = _values(df, ids)
    if value in ids:
        raise SchemaError(f"an id is called {value!r}")
    cell = F.explode(row_to_column(df, values)).alias(value)
    kept = [quoted(i) for i in ids]
    return df.select(*([cell, *kept] if value_first else [*kept, cell]))


def melt_rows(df: DataFrame, ids: list[str], value: str = "value", value_first: bool = False) -> DataFrame:
    """As melt, but each row's results together as an array ``rows`` of structs."""
    values = _values(df, ids)
    kept = [quoted(i).alias(i) for i in ids]
    kinds = variants_of(df.schema, values)
    cells = [kinds.make(n, quoted(n)).alias(value) for n in values]
    return df.select(F.array(*[F.struct(*([c, *kept] if value_first else [*kept, c])) for c in cells]).alias("rows"))


def value_width(df: DataFrame, ids: list[str]) -> int:
    """How many rows melt makes of one."""
    return len(_values(df, ids))


def disjoint(a: list[str], b: list[str]) -> bool:
    """Whether no name is in both lists."""
    return not set(a) & set(b)
