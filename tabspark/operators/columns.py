"""Projection, update and arithmetic on the columns of a table, checked against its schema before anything runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import SchemaError
from tabspark.functions.rendering import show_literal
from tabspark.session import quoted


def require(df: DataFrame, *names: str, kind: type[T.DataType] | tuple[type[T.DataType], ...] | None = None) -> None:
    """SchemaError unless the columns exist, once each, and are of the kind of type."""
    for name in names:
        if df.columns.count(name) != 1:
            raise SchemaError(f"column {name!r} is there {df.columns.count(name)} times; there are {df.columns}")
        if kind is not None and not isinstance(df.schema[name].dataType, kind):
            raise SchemaError(f"column {name!r} is {df.schema[name].dataType.simpleString()}")


def same_type(df: DataFrame, names: list[str]) -> T.DataType:
    """The one type of all the columns, or SchemaError."""
    require(df, *names)
    kinds = {df.schema[n].dataType.simpleString() for n in names}
    if len(kinds) != 1:
        raise SchemaError(f"columns {names} are of types {sorted(kinds)}")
    return df.schema[names[0]].dataType


def project(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, in this order."""
    require(df, *names)
    return df.select(*[quoted(n) for n in names])


def field(df: DataFrame, name: str) -> Column:
    """One column, to read."""
    require(df, name)
    return quoted(name)


def field_at(df: DataFrame, place: int) -> Column:
    """The column at a place from 0."""
    if not 0 <= place < len(df.columns):
        raise SchemaError(f"no column {place} of {len(df.columns)}")
    return quoted(df.columns[place])


def update(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """New values for some columns; their places and types must stay, and so do the other columns."""
    require(df, *changes)
    out = df.select(*[changes[n].alias(n) if n in changes else quoted(n) for n in df.columns])
    for n in changes:
        if out.schema[n].dataType != df.schema[n].dataType:
            raise SchemaError(f"column {n!r} would change from {df.schema[n].dataType.simpleString()} to {out.schema[n].dataType.simpleString()}")
    return out


def put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """update of one column."""
    return update(df, {name: value})


def modify(df: DataFrame, name: str, change: Callable[[Column], Column]) -> DataFrame:
    """One column changed by a function of itself."""
    require(df, name)
    return update(df, {name: change(quoted(name))})


def update_subset(df: DataFrame, names: list[str], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A part of the columns changed by a function of a table of only these; the others stay in place.

    The function may only derive columns (no filter, join or aggregate), as its result is taken row by row.
    """
    require(df, *names)
    inner = change(df.select(*[quoted(n) for n in names]))
    if inner.columns != names:
        raise SchemaError(f"the change gives {inner.columns} for {names}")
    together = change(df.select(*[quoted(n) for n in names], F.struct(*[quoted(n) for n in df.columns]).alias("_whole")))
    if "_whole" not in together.columns:
        raise SchemaError("the change must keep further columns")
    return together.select(*[quoted(n) if n in names else F.col("_whole").getField(n).alias(n) for n in df.columns])


def prepend(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A further column in first place."""
    if name in df.columns:
        raise SchemaError(f"there is a column {name!r}")
    return df.select(value.alias(name), *[quoted(n) for n in df.columns])


def append(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A further column in last place."""
    if name in df.columns:
        raise SchemaError(f"there is a column {name!r}")
    return df.select(*[quoted(n) for n in df.columns], value.alias(name))


def append_records(df: DataFrame, *records: str) -> DataFrame:
    """The fields of some struct columns side by side, as columns: those of one record after those of another."""
    require(df, *records, kind=T.StructType)
    names = [f.name for r in records for f in df.schema[r].dataType.fields]
    if len({n.lower() for n in names}) < len(names):
        raise SchemaError(f"fields of several records: {names}")
    return df.select(*[quoted(r).getField(f.name).alias(f.name) for r in records for f in df.schema[r].dataType.fields])


def first_and_rest(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first column alone, and the others."""
    if not df.columns:
        raise SchemaError("no columns")
    return df.select(quoted(df.columns[0])), df.select(*[quoted(n) for n in df.columns[1:]])


def delete(df: DataFrame, name: str) -> DataFrame:
    """All columns but one, which must be there."""
    require(df, name)
    return df.select(*[quoted(n) for n in df.columns if n != name])


def first_to_last(df: DataFrame) -> DataFrame:
    """The first column moved to the last place."""
    return df.select(*[quoted(n) for n in df.columns[1:] + df.columns[:1]])


def map_same(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """The same function on every column of a table whose columns are all of one type; the type may change."""
    same_type(df, df.columns)
    return df.select(*[change(quoted(n)).alias(n) for n in df.columns])


def map_numeric(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """The same function on every column, all of which must be numbers; each keeps its type."""
    require(df, *df.columns, kind=T.NumericType)
    return df.select(*[change(quoted(n)).cast(df.schema[n].dataType).alias(n) for n in df.columns])


def to_list(df: DataFrame, name: str = "values") -> DataFrame:
    """One array a row of the values of a table whose columns are all of one type."""
    same_type(df, df.columns)
    return df.select(F.array(*[quoted(n) for n in df.columns]).alias(name))


def shown_fields(df: DataFrame, name: str = "shown") -> DataFrame:
    """One array a row of the values as literals."""
    return df.select(F.array(*[show_literal(quoted(f.name), f.dataType) for f in df.schema.fields]).alias(name))


def shown_field(df: DataFrame, name: str, parentheses: bool = False) -> Column:
    """``name :-> literal`` of one column, in parentheses if wanted; null where the cell is."""
    require(df, name)
    text = F.concat(F.lit(f"{name} :-> "), show_literal(quoted(name), df.schema[name].dataType))
    return F.concat(F.lit("("), text, F.lit(")")) if parentheses else text


def headers(df: DataFrame) -> list[str]:
    return df.columns


def apply_row(df: DataFrame, names: list[str], function: Callable[..., Column], out: str) -> DataFrame:
    """One derived column: a function of the named columns, in their order."""
    require(df, *names)
    return df.select(function(*[quoted(n) for n in names]).alias(out))


def schema_subset(part: T.StructType, whole: T.StructType) -> bool:
    """Whether every column of ``part`` is in ``whole`` by name and type."""
    kinds = {f.name: f.dataType for f in whole.fields}
    return all(kinds.get(f.name) == f.dataType for f in part.fields)


def schema_without(schema: T.StructType, names: list[str]) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in names])


def schema_replaced(schema: T.StructType, kind: T.DataType) -> T.StructType:
    """The same names, all of one type."""
    return T.StructType([T.StructField(f.name, kind, f.nullable) for f in schema.fields])


def columns_of_type(schema: T.StructType, kind: type[T.DataType]) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, kind)]
