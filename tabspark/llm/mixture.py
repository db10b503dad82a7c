"""A mixture of sources by target shares, by weighted fair queueing.

Each source's documents stand in a shuffled queue. A document's virtual finish time is the tokens of its source up to and
with it, divided by the source's weight; the mixture takes documents by finish time until its budget of tokens is spent.
Running sums are taken in two steps, over a bounded number of parts and then within each, so no queue is ever in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.errors import SchemaError
from tabspark.llm.tokens import Vocabulary, encode_corpus
from tabspark.session import cut_lineage, quoted

MOST_SOURCES = 10_000
#: Parts of a queue grow with the tokens, up to a number whose sums still fit one task.
PART_TOKENS, MOST_PARTS = 100_000_000, 1 << 20


@dataclass(frozen=True)
class Target:
    share: float
    repeats: int


def read_targets(targets: DataFrame) -> dict[str, Target]:
    """The targets as a dictionary. They describe sources, not rows: over MOST_SOURCES are refused."""
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise SchemaError(f"more than {MOST_SOURCES} sources")
    return {r.source: Target(float(r.target_share), int(r.max_repeats)) for r in rows}


def level_for(budget: float, totals: dict[str, int], targets: dict[str, Target]) -> float:
    """The virtual time at which the queues have given ``budget`` tokens, or all they may."""
    ends = sorted((totals[s] * targets[s].repeats / targets[s].share, s) for s in totals)
    given, rate, now = 0.0, sum(targets[s].share for s in totals), 0.0
    for end, source in ends:
        if given + rate * (end - now) >= budget:
            return now + (budget - given) / rate
        given, now, rate = given + rate * (end - now), end, rate - targets[source].share
    return now


def largest_budget(totals: dict[str, int], targets: dict[str, Target]) -> int:
    """The tokens of the largest mixture in which every source that has tokens reaches its share of it.

    Sources without tokens give nothing; the others have their shares of what the mixture then holds.
    """
    given = sum(targets[s].share for s in totals)
    return int(min((totals[s] * targets[s].repeats / targets[s].share for s in totals), default=0) * given + 1e-6)


def running(df: DataFrame, by: list[str], part: str, order: list, size: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows of ``by`` up to and with each, parts in order, rows by ``order`` in a part."""
    sums = df.groupBy(*by, part).agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_inside", F.sum(size).over(inside)).join(offsets, [*by, part]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def mix_sources(
    df: DataFrame, key: str, text: str, source: str, targets: dict[str, Target], budget: int | None = None,
    seed: int = 42, parts: int | None = None, vocabulary: Vocabulary = Vocabulary(),
) -> tuple[DataFrame, DataFrame]:
    """The mixture and the report of its shares.

    Mixture: (doc_id, source, copy, n_tokens, finish, running_tokens) in order of finish, one row per use of a document;
    copy counts from 0. Report: (source, target_share, max_repeats, available_tokens, mixed_tokens, actual_share, uses).

    ``budget`` is the mixture's size in tokens; by default the largest at which every source with tokens reaches its share,
    so that only sources without any fall short. A source that is used up ``max_repeats`` times gives no more; with a larger
    budget the others then share the rest by their weights. Documents of other
    or null sources, and those without tokens (null or empty text), take no part. ``key`` should be unique: repeated keys
    are all used, their order among themselves is by size. An empty table gives an empty mixture and a report of zeros.
    """
    slim = df.select(quoted(key).alias("doc_id"), quoted(source).alias("source"), quoted(text).alias("text")).where(F.col("source").isin(list(targets)))
    sized = cut_lineage(encode_corpus(slim, "text", vocabulary, None, "n_tokens").where("n_tokens > 0"))
    totals = {r.source: int(r.t) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # at most one row per target
    budget = largest_budget(totals, targets) if budget is None else budget
    level = level_for(budget, totals, targets)
    parts = parts or int(min(max(4096, sum(totals.values()) // PART_TOKENS), MOST_PARTS))

    lookup = lambda f: F.element_at(F.create_map(*[F.lit(x) for s in (totals or {"": 0}) for x in (s, f(s))]), F.col("source"))
    weight = lookup(lambda s: targets[s].share if s in targets else 1.0)
    total, repeats = lookup(lambda s: totals.get(s, 0)).cast("bigint"), lookup(lambda s: targets[s].repeats if s in targets else 0).cast("bigint")
    queue = sized.withColumn("place", F.xxhash64("doc_id", F.lit(seed))).withColumn("part", F.pmod(F.shiftrightunsigned("place", 40), F.lit(1 << 24)) % parts)
    queue = running(queue, ["source"], "part", ["place", "doc_id", "n_tokens"], "n_tokens", "upto")
    # A use counts if it begins before the level; the cut at the budget itself comes after the sort.
    begins = (F.col("upto") - F.col("n_tokens")) / weight
    uses = F.least(repeats - 1, F.floor((F.lit(level) - begins) / (total / weight)))
    used = queue.where(begins < level).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), uses)))
    used = used.withColumn("finish", (F.col("copy") * total + F.col("upto")) / weight)
    # Queues give tokens evenly over virtual time, so equal stretches of it are ranges of about equal size.
    used = used.withColumn("part", F.least(F.floor(F.col("finish") / F.lit(level or 1.0) * parts), F.lit(parts)))
    order = ["finish", "source", "place", "doc_id", "copy"]
    mixed = running(used.withColumn("all", F.lit(0)), ["all"], "part", order, "n_tokens", "running_tokens").where(F.col("running_tokens") <= budget)
    mixture = mixed.orderBy(*order).select("doc_id", "source", "copy", "n_tokens", "finish", "running_tokens")

    spark = df.sparkSession
    wanted = spark.createDataFrame([(s, t.share, t.repeats, totals.get(s, 0)) for s, t in sorted(targets.items())], "source string, target_share double, max_repeats bigint, available_tokens bigint")
    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("uses"))
    both = wanted.join(reached, "source", "left").na.fill(0, ["mixed_tokens", "uses"])
    whole = reached.agg(F.sum("mixed_tokens")).scalar()
    report = both.select("source", "target_share", "max_repeats", "available_tokens", "mixed_tokens", F.coalesce(F.col("mixed_tokens") / whole, F.lit(0.0)).alias("actual_share"), "uses")
    return mixture, report
