"""Keeping results in memory, and running plans for their effects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row

from tabspark.operators.columns import project


def in_memory(df: DataFrame, *names: str) -> DataFrame:
    """The table, or only the named columns, kept in columnar form once computed; what does not fit goes to disk."""
    return (project(df, *names) if names else df).persist(StorageLevel.MEMORY_AND_DISK)


def in_memory_after(df: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As in_memory of what the change makes of the table."""
    return in_memory(change(df))


def with_length(df: DataFrame) -> tuple[int, DataFrame]:
    """The number of rows and the kept table."""
    kept = in_memory(df)
    return kept.count(), kept


def replay(df: DataFrame) -> Callable[[], Iterator[Row]]:
    """A function that gives the rows, one partition in the driver at a time, as often as it is called."""
    kept = in_memory(df)
    return lambda: kept.toLocalIterator(prefetchPartitions=True)


def force(df: DataFrame) -> DataFrame:
    """Computes every row and cell, and returns the table."""
    df.write.format("noop").mode("overwrite").save()
    return df
