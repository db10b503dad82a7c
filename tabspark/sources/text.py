"""Lines and tokens of text files as DataFrames, in batch and streaming."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.functions.tokenize import tokens_of
from tabspark.session import pinned
from tabspark.sources.options import ParserOptions

FILE, BLOCK = "_file", "_block"


def _decoded(encoding: str | None):  # noqa: ANN202
    raw = F.col("value").cast("binary")
    return F.decode(raw, encoding) if encoding else F.col("value")


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files below a path in the order of their paths, as paths that can be read (no glob in them)."""
    found = sorted(unquote(f) for f in spark.read.text(path).inputFiles())
    return [re.sub(r"([\\*?\[\]{}])", r"\\\1", f) for f in found]


def read_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(value): the lines of a file or folder, decoded; read errors are raised. Carriage returns before line ends go."""
    return spark.read.text(path).select(F.regexp_replace(_decoded(encoding), r"\r\z", "").alias("value"))


def _drop_first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (value, file, block) in file order, those that are not the first of a file."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(1), np.asarray(batch.column(2))
        codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        begins = np.append(True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1]))
        begins[0] = (files[0].as_py(), blocks[0]) != last
        last = (files[-1].as_py(), blocks[-1])
        yield batch.filter(pa.array(~(begins & (blocks == 0))))


def data_lines(lines: DataFrame, options: ParserOptions, with_places: bool = False) -> DataFrame:
    """(value): of a ``read.text`` or ``readStream.text`` DataFrame, the lines that hold data: all but each file's first,
    or all if the options name the columns. Only the split that starts a file has its first line, so files stay splittable.

    ``with_places`` adds FILE and BLOCK, the file and the first byte of the split: in a task, lines of a split come in order.
    """
    whence = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK)]
    raw = lines.select(F.col("value").cast("binary").alias("value"), *whence) if with_places or options.header is None else lines
    if options.header is None:
        raw = raw.mapInArrow(_drop_first_lines, raw.schema)
    text = F.decode(F.col("value").cast("binary"), options.encoding) if options.encoding else F.col("value").cast("string")
    return raw.select(F.regexp_replace(text, r"\r\z", "").alias("value"), *([FILE, BLOCK] if with_places else []))


def read_tokens(spark: SparkSession, path: str, options: ParserOptions = ParserOptions()) -> DataFrame:
    """(tokens): the tokens of every line, a header line included."""
    return tokenize(read_lines(spark, path, options.encoding), options)


def tokenize(lines: DataFrame, options: ParserOptions) -> DataFrame:
    """(tokens), and the other columns of ``lines`` but ``value``."""
    return lines.select(pinned(tokens_of(F.col("value"), options)).alias("tokens"), *[c for c in lines.columns if c != "value"])


def rfc4180_tokens(spark: SparkSession, path: str, columns: int, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """(tokens): by Spark's CSV parser, with quoted line breaks. One such file is read by one task. For ``token_reader``."""
    names = [f"c{i}" for i in range(columns)]
    options = {"sep": separator, "multiLine": "true", "escape": '"', "encoding": encoding, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    df = spark.read.options(**options).schema(", ".join(f"{n} string" for n in names)).csv(path)
    return df.select(F.array(*[F.coalesce(F.col(n), F.lit("")) for n in names]).alias("tokens"))
