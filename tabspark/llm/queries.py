"""Queries of this subpackage over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm import mixture, quantiles, repetition, tokens, topn

Query = Callable[[SparkSession, str], DataFrame]
SHARES = [0.5, 0.9, 0.99]
ERROR = 0.005


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    """One summary of hwy and of cty per class and load_day."""
    cars = table(spark, folder, "mpg").select(F.lower(F.trim("class")).alias("class"), "load_day", "hwy", "cty")
    return quantiles.combine(quantiles.summarise(cars, ["class", "load_day"], ["hwy", "cty"], ERROR), ["class", "load_day"], ERROR)


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Over all days, from the days' summaries."""
    return quantiles.percentiles(quantiles.combine(_daily(spark, folder), ["class"], ERROR), ["class"], SHARES)


def p2_daily(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.percentiles(_daily(spark, folder), ["class", "load_day"], SHARES)


def p2_true_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each stated bound of p2_percentiles holds in the data: the value's true ranks overlap the stated ones, and the
    wanted rank is off by no more than the stated error, which is no more than ERROR of the rows (and one rank)."""
    stated = p2_percentiles(spark, folder)
    cars = table(spark, folder, "mpg").select(F.lower(F.trim("class")).alias("class"), F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in ("hwy", "cty")])).alias("e"))
    counts = cars.select(F.col("class").alias("_class"), F.col("e.measure").alias("_measure"), F.col("e.x").alias("x")).where("x is not null").groupBy("_class", "_measure", "x").agg(F.count(F.lit(1)).alias("w"))
    both = stated.join(counts, F.col("class").eqNullSafe(F.col("_class")) & (F.col("measure") == F.col("_measure")))
    ranks = both.groupBy("class", "measure", "share", "value", "n", "rank_low", "rank_high", "rank_error").agg(
        F.sum(F.when(F.col("x") < F.col("value"), F.col("w")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x") <= F.col("value"), F.col("w")).otherwise(0)).alias("upto"), F.sum("w").alias("rows")
    )
    wanted = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n") - 1e-9))
    off = F.greatest(F.lit(0), F.col("below") + 1 - wanted, wanted - F.col("upto"))
    holds = (F.col("rows") == F.col("n")) & (F.col("rank_low") <= F.col("upto")) & (F.col("rank_high") > F.col("below")) & (off <= F.col("rank_error")) & (F.col("rank_error") <= ERROR * F.col("n") + 1)
    return ranks.select("class", "measure", "share", holds.alias("holds"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    cars = table(spark, folder, "mpg").select("manufacturer", "row_no", "hwy", "cty").where("manufacturer is not null and hwy is not null")
    order = [F.col("hwy").desc(), F.col("cty").desc_nulls_last(), F.col("row_no").asc()]
    return topn.top_n(cars, F.lower(F.trim("manufacturer")), order, 5, "maker").select("maker", "row_no")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents").select("doc_id", "text"), "text")


def p7_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of long texts: the texts of each five thousand consecutive doc_id (so many at most), joined by line breaks."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.floor((F.col("doc_id") - 1) / 5000).alias("joined"))
    together = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    return tokens.encode_corpus(docs.groupBy("joined").agg(together.alias("text")), "text")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = mixture.read_targets(table(spark, folder, "mix_targets"))
    return mixture.mix_sources(table(spark, folder, "documents"), "doc_id", "text", "source", targets)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p8_records(spark: SparkSession, folder: str) -> DataFrame:
    """The uses of p8_mixture with their whole records, copies included, in the order of the mixture."""
    return _mixed(spark, folder)[0].join(table(spark, folder, "documents").drop("source"), "doc_id").orderBy("running_tokens")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the mixture keeps its promises, for each source: its share is met within one document unless it has no
    tokens, no document is used more often than it may be, and the running tokens are those of the uses."""
    mixture, report = _mixed(spark, folder)
    uses = mixture.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses")).groupBy("source").agg(F.max("uses").alias("most"))
    whole = mixture.agg(F.sum("n_tokens").alias("tokens"), F.max("running_tokens").alias("upto"), F.max("n_tokens").alias("largest"))
    some = report.where("available_tokens > 0").agg(F.sum("target_share").alias("shares"))
    facts = report.join(uses, "source", "left").crossJoin(whole).crossJoin(some)  # one row each
    met = F.abs(F.col("mixed_tokens") - F.col("target_share") / F.col("shares") * F.col("tokens")) <= F.col("largest")
    return facts.select("source", F.when(F.col("available_tokens") == 0, F.col("mixed_tokens") == 0).otherwise(met & (F.col("most") <= F.col("max_repeats"))).alias("kept"), (F.col("tokens") == F.col("upto")).alias("sums"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    measured = repetition.repeated_share(table(spark, folder, "documents").select("doc_id", "text"), "text", 30)
    return measured.where("kept_chars > 0 and repeated_chars * 5 >= kept_chars * 2").select("doc_id").distinct()


def p9_share(spark: SparkSession, folder: str) -> DataFrame:
    """The share of repeated characters of every document, null where it has no letter or digit."""
    measured = repetition.repeated_share(table(spark, folder, "documents").select("doc_id", "text"), "text", 30)
    return measured.select("doc_id", "kept_chars", "repeated_chars", F.when(F.col("kept_chars") > 0, F.col("repeated_chars") / F.col("kept_chars")).alias("repeated_share"))


def p9_fertility(spark: SparkSession, folder: str) -> DataFrame:
    """Tokenizer fertility of every document and the measures outside its script's bands."""
    return repetition.outside_bands(table(spark, folder, "documents").select("doc_id", "text"), "text")


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p2_percentiles, p2_daily, p2_true_ranks, p4_found, p7_ids, p7_joined, p8_mixture, p8_records, p8_shares, p8_kept, p9_found, p9_share, p9_fertility)
}

_SHARE_SQL = r"""
with kept as (select doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') as k from documents),
stretches as (select doc_id, k, unnest(range(1, length(k) - 28)) as i from kept where length(k) >= 30),
placed as (select doc_id, i, row_number() over (partition by doc_id, substr(k, i, 30) order by i) as seen from stretches),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 30)) as p from placed where seen > 1) group by doc_id)
select doc_id, length(k) as kept_chars, coalesce(n, 0) as repeated_chars, case when length(k) > 0 then coalesce(n, 0) / length(k) end as repeated_share
from kept left join covered using (doc_id)
"""

ORACLES: dict[str, str] = {
    "p2_true_ranks": """select class, measure, share, true as holds from (select distinct lower(trim(class, ' ')) as class, measure from mpg,
  (values ('hwy'), ('cty')) m(measure) where case when measure = 'hwy' then hwy else cty end is not null), (values (0.5::double), (0.9::double), (0.99::double)) s(share)""",
    "p8_kept": "select source, true as kept, true as sums from mix_targets where source is not null and target_share > 0 and max_repeats > 0",
    "p9_share": _SHARE_SQL,
    "p9_found": f"select distinct doc_id from ({_SHARE_SQL}) where kept_chars > 0 and repeated_chars * 5 >= kept_chars * 2",
    "p4_found": """
select maker, row_no from (
  select lower(trim(manufacturer, ' ')) as maker, row_no,
    row_number() over (partition by lower(trim(manufacturer, ' ')) order by hwy desc, cty desc nulls last, row_no) as place
  from mpg where manufacturer is not null and hwy is not null)
where place <= 5
""",
}
