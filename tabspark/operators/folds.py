"""Aggregates over whole tables that combine into one pass."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.session import quoted

BRANCHES = 64


@dataclass(frozen=True)
class Fold:
    """An aggregate: a function from the condition under which rows count (None: always) to its column."""

    build: Callable[[Column | None], Column]

    def column(self) -> Column:
        return self.build(None)

    def where(self, test: Column) -> Fold:
        """The same aggregate over the rows for which the test holds."""
        return Fold(lambda c: self.build(test if c is None else test & c))

    def map(self, change: Callable[[Column], Column]) -> Fold:
        """A function of the aggregate's result."""
        return Fold(lambda c: change(self.build(c)))

    def join(self, other: Fold, combine: Callable[[Column, Column], Column]) -> Fold:
        """A function of two aggregates' results, found in the same pass."""
        return Fold(lambda c: combine(self.build(c), other.build(c)))


def _if(c: Column | None, value: Column) -> Column:
    return value if c is None else F.when(c, value)


def total(value: Column) -> Fold:
    """The sum, 0 if there are no rows."""
    return Fold(lambda c: F.coalesce(F.sum(_if(c, value)), F.lit(0)))


def count() -> Fold:
    """The number of rows."""
    return Fold(lambda c: F.count(_if(c, F.lit(1))))


def mean(value: Column) -> Fold:
    """Sum by number of non-null values; not a number if there are none."""
    return Fold(lambda c: F.coalesce(F.avg(_if(c, value)), F.lit(float("nan"))))


def minimum(value: Column) -> Fold:
    """The least value, null if there is none."""
    return Fold(lambda c: F.min(_if(c, value)))


def maximum(value: Column) -> Fold:
    """The greatest value, null if there is none."""
    return Fold(lambda c: F.max(_if(c, value)))


def run(df: DataFrame, **folds: Fold) -> DataFrame:
    """One row with all results, in one pass over only the columns they use."""
    return df.agg(*[fold.column().alias(name) for name, fold in folds.items()])


def run_by(df: DataFrame, keys: list[str], **folds: Fold) -> DataFrame:
    """One row with all results for each group of the keys; null keys are a group. Groups are aggregated before they move."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(*[fold.column().alias(name) for name, fold in folds.items()])


def fold_batches(df: DataFrame, zero: Callable[[], object], step: Callable[[object, pa.RecordBatch], object], merge: Callable[[object, object], object]) -> object:
    """Any fold whose states merge: each partition is folded where it lies, states are merged in a tree, the last few here.

    States should stay small; BRANCHES of them come to the driver. They may merge in any order.
    """

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = zero(), False
        for batch in batches:
            state, some = step(state, batch), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    def branch(table: pa.Table) -> pa.Table:
        state = zero()
        for blob in table.column("state").to_pylist():
            state = merge(state, pickle.loads(blob))  # noqa: S301  written above
        return pa.table({"state": pa.array([pickle.dumps(state)], pa.binary())})

    states = df.mapInArrow(partition, "state binary").withColumn("branch", F.spark_partition_id() % BRANCHES)
    result = zero()
    for row in states.groupBy("branch").applyInArrow(branch, "state binary").collect():
        result = merge(result, pickle.loads(bytes(row.state)))  # noqa: S301
    return result
