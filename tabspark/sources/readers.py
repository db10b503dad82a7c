"""Typed rows from delimited files under four policies for cells that do not parse."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.functions.tokenize import tokens_of
from tabspark.operators.rows import place_by_file
from tabspark.session import pinned
from tabspark.sources.infer import TableSpec
from tabspark.sources.options import RFC4180Quoting
from tabspark.sources.text import BLOCK, FILE, data_lines, tokenize


def _cells(spec: TableSpec, tokens: Column) -> list[tuple[str, Column, Column, dict]]:
    """(name, raw token, parsed value, metadata) by position: absent tokens are null in both, surplus tokens are ignored."""
    out = []
    for i, field in enumerate(spec.schema.fields):
        raw = F.get(tokens, F.lit(i))
        out.append((field.name, raw, spec.types[i].parse(raw).cast(field.dataType), field.metadata))
    return out


def parse_maybe(tokens: DataFrame, spec: TableSpec, *keep: str) -> DataFrame:
    """Rows of (tokens) with the spec's columns; a cell that does not parse or is absent is null. Text always parses.

    Columns of ``tokens`` named in ``keep`` come after them.
    """
    return tokens.select(*[pinned(value).alias(name, metadata=meta) for name, _, value, meta in _cells(spec, F.col("tokens"))], *keep)


def parse_strict(tokens: DataFrame, spec: TableSpec, *keep: str) -> DataFrame:
    """As parse_maybe, without the rows that have a null cell."""
    return complete_rows(parse_maybe(tokens, spec, *keep))


def parse_either(tokens: DataFrame, spec: TableSpec, *keep: str) -> DataFrame:
    """Each column as struct<value, raw>: raw is the token of a cell that did not parse (empty for an absent one), else null."""
    cells = _cells(spec, F.col("tokens"))
    return tokens.select(*[F.struct(value.alias("value"), F.when(value.isNull(), F.coalesce(raw, F.lit(""))).alias("raw")).alias(name, metadata=meta) for name, raw, value, meta in cells], *keep)


def parse_checked(tokens: DataFrame, spec: TableSpec) -> DataFrame:
    """(ok, row, failed): ``row`` if all cells parse, else ``failed`` with each cell as in parse_either."""
    either = parse_either(tokens, spec)
    names = either.columns
    ok = F.lit(True)
    for n in range(len(names)):
        ok = ok & F.col(f"r.c{n}.value").isNotNull()
    r = F.struct(*[either[name].alias(f"c{n}") for n, name in enumerate(names)])
    row = F.struct(*[F.col(f"r.c{n}.value").alias(name) for n, name in enumerate(names)])
    failed = F.struct(*[F.col(f"r.c{n}").alias(name) for n, name in enumerate(names)])
    return either.select(r.alias("r")).select(ok.alias("ok"), F.when(ok, row).alias("row"), F.when(~ok, failed).alias("failed"))


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a null in any column."""
    return df.dropna("any")


def read_tokens_of(spark: SparkSession, path: str, spec: TableSpec, with_places: bool = False) -> DataFrame:
    """(tokens): the data lines of a file or folder, tokenized as the spec says; with FILE and BLOCK if wanted."""
    options = replace(spec.options, quoting=RFC4180Quoting()) if spec.options.ignore_quoting else spec.options
    return tokenize(data_lines(spark.read.text(path), options, with_places), options)


def _read(spark: SparkSession, path: str, spec: TableSpec, parse: Callable[..., DataFrame], placed: bool) -> DataFrame:
    if not placed:
        return parse(read_tokens_of(spark, path, spec), spec)
    return place_by_file(parse(read_tokens_of(spark, path, spec, True), spec, FILE, BLOCK), FILE, BLOCK)


def read_table_maybe(spark: SparkSession, path: str, spec: TableSpec, placed: bool = False) -> DataFrame:
    """All rows; cells that do not parse are null.

    This and the other readers of whole tables add, if ``placed``, the column ROW_ID: the places of the rows from 0, files
    in the order of their paths, lines in the order of the file. The rows are written once for that.
    """
    return _read(spark, path, spec, parse_maybe, placed)


def read_table(spark: SparkSession, path: str, spec: TableSpec, placed: bool = False) -> DataFrame:
    """Only the rows whose cells all parse."""
    return _read(spark, path, spec, parse_strict, placed)


def read_table_either(spark: SparkSession, path: str, spec: TableSpec, placed: bool = False) -> DataFrame:
    """All rows, with the raw text of cells that do not parse."""
    return _read(spark, path, spec, parse_either, placed)


def read_table_debug(spark: SparkSession, path: str, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """The rows whose cells all parse, and the others as in read_table_either."""
    checked = parse_checked(read_tokens_of(spark, path, spec), spec)
    return checked.where("ok").select("row.*"), checked.where("not ok").select("failed.*")


def parse_line(line: Column, spec: TableSpec) -> Column:
    """One line as a struct of cells as in parse_either."""
    cells = _cells(spec, tokens_of(line, spec.options))
    return F.struct(*[F.struct(value.alias("value"), F.when(value.isNull(), F.coalesce(raw, F.lit(""))).alias("raw")).alias(name) for name, raw, value, _ in cells])
