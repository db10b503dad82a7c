"""Equi-joins on columns of equal name and type. Results have the left columns in their order, then the right ones without keys."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabspark.errors import SchemaError
from tabspark.operators.columns import require
from tabspark.session import quoted


def _join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    if not keys:
        raise SchemaError("a join needs a key")
    require(left, *keys)
    require(right, *keys)
    for k in keys:
        a, b = left.schema[k].dataType, right.schema[k].dataType
        if a != b:
            raise SchemaError(f"key {k!r} is {a.simpleString()} on the left and {b.simpleString()} on the right")
    rest = [c for c in right.columns if c not in keys]
    if both := set(left.columns) & set(rest):
        raise SchemaError(f"columns in both tables: {sorted(both)}; rename them")
    return left.join(right, list(keys), how).select(*[quoted(c) for c in left.columns + rest])


def inner_join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Pairs of rows with equal keys. Null keys match nothing, here and below. Spark picks the strategy by size."""
    return _join(left, right, keys, "inner")


def left_join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """As inner_join, and left rows without a match, the right columns null."""
    return _join(left, right, keys, "left")


def right_join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """As inner_join, and right rows without a match with their own keys, the other left columns null."""
    return _join(left, right, keys, "right")


def outer_join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """As inner_join, and the rows of both sides without a match; keys come from the side that is there."""
    return _join(left, right, keys, "full")
