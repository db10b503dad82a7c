"""Delimited text and screen output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.functions.rendering import show_literal, show_plain
from tabspark.session import quoted
from tabspark.sources.options import ParserOptions


def line_of(df: DataFrame, separator: str = ",", quote_output: bool = False) -> Column:
    """A row as one line. Nothing is quoted, as text may not hold the separator; with ``quote_output`` what needs it is.

    Missing cells are empty.
    """
    cells = []
    for f in df.schema.fields:
        cell = F.coalesce(show_plain(quoted(f.name), f.dataType), F.lit(""))
        cell = F.when(quoted(f.name).isNull(), "").otherwise(cell)
        if quote_output:
            risky = cell.contains(separator) | cell.contains('"') | cell.rlike(r"(?U)\A\s|\s\z")
            cell = F.when(risky, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)
        cells.append(cell)
    return F.concat_ws(separator, *cells)


def dsv_lines(df: DataFrame, options: ParserOptions = ParserOptions(), quote_output: bool = False) -> DataFrame:
    """(line): the header, then one line a row. The header is a partition of its own, before the others."""
    head = df.sparkSession.createDataFrame([(options.separator.join(df.columns),)], "line string").coalesce(1)
    return head.union(df.select(line_of(df, options.separator, quote_output).alias("line")))


def csv_lines(df: DataFrame) -> DataFrame:
    return dsv_lines(df)


def write_dsv(df: DataFrame, path: str, options: ParserOptions = ParserOptions(), quote_output: bool = False, one_file: bool = False, mode: str = "errorifexists") -> None:
    """Writes a folder of text files, each with the header, one for each partition; or a single file, by one task."""
    if one_file:
        dsv_lines(df, options, quote_output).coalesce(1).write.mode(mode).text(path)
        return
    head = options.separator.join(df.columns)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], names=["line"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["line"])

    df.select(line_of(df, options.separator, quote_output).alias("line")).mapInArrow(headed, "line string").write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, **more) -> None:  # noqa: ANN003
    write_dsv(df, path, **more)


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes a table of one text column as it is."""
    lines.write.mode(mode).text(path)


def shown_lines(df: DataFrame, separator: str = "\t") -> Iterator[str]:
    """The header and the rows as literals, line by line, with one partition in the driver at a time."""
    yield separator.join(df.columns)
    line = F.concat_ws(separator, *[F.coalesce(show_literal(quoted(f.name), f.dataType), F.lit("")) for f in df.schema.fields])
    for row in df.select(line.alias("line")).toLocalIterator():
        yield row.line


def show_frame(df: DataFrame, separator: str = "\t") -> str:
    """All lines of shown_lines as one text."""
    return "".join(line + "\n" for line in shown_lines(df, separator))


def print_frame(df: DataFrame, separator: str = "\t") -> None:
    for line in shown_lines(df, separator):
        print(line)


def preview(df: DataFrame, change: Callable[[DataFrame], DataFrame], n: int = 10) -> None:
    """Prints the first ``n`` rows of what the change makes of the table; only as much is computed as these need."""
    change(df).limit(n).show(n, truncate=False)
