"""Files that keep arriving, as streams of typed rows, and streams written as delimited text.

Row-local operators (parsing, projection, filters, melt, rendering) are the same on streams. Those that need places, whole
tables or inference are for batches only; a stream takes a spec inferred once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabspark.operators import orphans
from tabspark.operators.rows import ROW_ID, place_by_file
from tabspark.sinks.dsv import line_of, write_dsv
from tabspark.sources.infer import TableSpec
from tabspark.sources.options import ParserOptions
from tabspark.sources.readers import parse_either, parse_maybe, parse_strict
from tabspark.sources.text import BLOCK, FILE, data_lines, tokenize

POLICIES = {"maybe": parse_maybe, "strict": parse_strict, "either": parse_either}


def stream_table(spark: SparkSession, folder: str, spec: TableSpec, policy: str = "strict", files_per_batch: int | None = None, placed: bool = False) -> DataFrame:
    """A stream of the typed rows of the files that come into a folder; each file's header line is left out.

    ``placed`` adds the columns FILE and BLOCK, by which stream_placed numbers the rows.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    tokens = tokenize(data_lines(reader.text(folder), spec.options, placed), spec.options)
    return POLICIES[policy](tokens, spec, *([FILE, BLOCK] if placed else []))


def stream_to_dsv(df: DataFrame, folder: str, checkpoint: str, options: ParserOptions = ParserOptions(), header: bool = True) -> StreamingQuery:
    """Writes a stream as delimited files, each row once even over restarts; ends when what is there is done.

    Each file begins with the header line, as in write_dsv; files lie in a folder ``batch=N`` for each micro-batch, which
    is written anew if the micro-batch comes again. Without ``header`` Spark's own text sink writes bare lines.
    """
    if header:
        return stream_chunks(df, checkpoint, lambda batch, n: write_dsv(batch, f"{folder}/batch={n}", options, mode="overwrite"))
    lines = df.select(line_of(df, options.separator).alias("line"))
    return lines.writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


def stream_chunks(df: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each micro-batch, as a table, with its number to a function; ends when what is there is done."""
    return df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_placed(df: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], first: int = 0, last: int | None = None, size: int | None = None) -> StreamingQuery:
    """Hands each micro-batch of a placed stream_table, with the places of its rows in the whole stream, to a function.

    Rows have ROW_ID: micro-batches in their order, in each files by path and lines in order. Only places from ``first``
    up to before ``last`` are handed on: that takes, drops or heads a stream. With ``size`` rows also have ``chunk``, so
    chunks are of exactly that many rows of the stream, whatever the micro-batches. The rows of each micro-batch are counted in
    the checkpoint folder, so that one which comes again has the same places.
    """
    if size is not None and size < 1:
        raise ValueError("a chunk has at least one row")

    def numbered(batch: DataFrame, number: int) -> None:
        placed = place_by_file(batch, FILE, BLOCK)
        spark, counts = batch.sparkSession, f"{checkpoint}/counts"
        placed.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{counts}/batch={number}")
        before = spark.read.schema("n bigint, batch int").parquet(counts).where(F.col("batch") < number).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        place = F.col(ROW_ID)
        placed = placed.withColumn(ROW_ID, place + before).where(place >= first)
        placed = placed if last is None else placed.where(place < last)
        work(placed if size is None else placed.withColumn("chunk", F.floor(place / size)), number)

    return stream_chunks(df, checkpoint, numbered)


def stream_events(df: DataFrame, time: str, late: str, length: str, groups: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Count, sum and mean of a value per window of event time and group; rows later than ``late`` are left out."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    summed = df.withWatermark(time, late).groupBy(window, *groups).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return summed.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *groups, "n", "total", "mean")


class OrphanStream:
    """Keeps orphan references up to date over micro-batches of references, with parents delivered in between.

    All of it is in the store's folder, so after a restart a stream on the same folder goes on, and a micro-batch or delivery
    that comes again counts once.
    """

    def __init__(self, store: orphans.OrphanStore):
        self.store = store
        self._no_refs = store.spark.createDataFrame([], store.refs)
        self._no_parents = store.spark.createDataFrame([], store.parents)

    def deliver_parents(self, parents: DataFrame, number: int | None = None) -> bool:
        """New parents, or new versions of parents. Their deliveries have numbers of their own."""
        return self.store.deliver(self._no_refs, parents, number, "parents")

    def deliver(self, references: DataFrame, batch: int | None = None) -> bool:
        """New references; fits stream_chunks."""
        return self.store.deliver(references, self._no_parents, batch, "references")
