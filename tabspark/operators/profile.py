"""Profile of every column per load, with induced column expressions, and the loads that differ from the load before.

A text column is described by one table of its distinct values with their numbers of rows per load, so raw rows are
shuffled once, after partial counting. Its expressions are induced by minimum description length over all distinct values.
Values of the same shape cost the same, so the choice is made on shapes, by aggregation alone. Columns of other types need
no expression: their type is one.
"""

from __future__ import annotations

import string
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tabspark.errors import SchemaError
from tabspark.operators.selection import exact_medians, salted_join
from tabspark.session import cut_lineage, pinned, quoted

NUMBER = r"\A-?[0-9]+(\.[0-9]+)?\z"
# Character classes as (symbol in a shape, class, bits to name one member).
CLASSES = [("9", "[0-9]", 3.33), ("A", "[A-Z]", 4.7), ("a", "[a-z]", 4.7), ("ä", r"[^\x00-\x7F]", 16.0), ("␣", r"\s", 2.6)]
# The classes inside brackets with others.
INSIDE = [("9", "0-9"), ("A", "A-Z"), ("a", "a-z"), ("ä", r"\x{80}-\x{10FFFF}"), ("␣", r"\s")]
# What a general form may hold besides, as (symbol, expression): a number with an optional sign and fraction,
# and a word of letters of either case, each of which takes WORD_MORE bits besides those of its class.
ATOMS = [("№", r"-?[0-9]+(\.[0-9]+)?"), ("ω", "[A-Za-z]+")]
WORD_MORE = 1.0
# Bits of an expression for each of its parts: a run of a class, a number (of all kinds of cells the commonest, so its code
# is shorter), a literal besides its own bits. A character of any text takes ANY_BITS.
ANY_BITS, CLASS_BITS, NUMBER_BITS, LITERAL_BITS = 8.0, 3.0, 2.0, 8.0


def value_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column_name, value, n): the distinct cells of each column and key, as text without outer spaces.

    A missing cell (null, or empty or ``NA`` without outer spaces) has a null value. Columns that are no text are taken as
    Spark prints them.
    """
    absent = [c for c in [*keys, *columns] if c not in df.columns]
    if absent or len(set(columns)) < len(columns):
        raise SchemaError(f"columns not there or named twice: {absent or columns}")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.trim(quoted(c).cast("string")).alias("value")) for c in columns]))
    long = df.select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)], cells.alias("cell")).select(*[f"k{i}" for i in range(len(keys))], "cell.column_name", "cell.value")
    return long.withColumn("value", F.when(~F.col("value").isin("", "NA"), F.col("value"))).groupBy(*[f"k{i}" for i in range(len(keys))], "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def shape_of(value: Column) -> Column:
    """The text with each character replaced by its class's symbol, and other characters by themselves after a backslash."""
    out = F.translate(value, string.digits + string.ascii_uppercase + string.ascii_lowercase, "9" * 10 + "A" * 26 + "a" * 26)
    marked = F.regexp_replace(out, r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x00-\x08\x0E-\x1B\x7F])", r"\\$1")
    whole = F.regexp_replace(F.regexp_replace(marked, r"\s", "␣"), r"[^\x00-\x7F␣]", "ä")
    # Most values need only the first steps.
    return F.when(out.rlike(r"\A[9Aa]*\z"), out).when(out.rlike(r"\A[\x21-\x7E]*\z"), marked).otherwise(whole)


def loosened(shape: Column) -> Column:
    """The shape with the lengths of its runs forgotten."""
    return reduce(lambda s, c: F.regexp_replace(s, f"(?<!\\\\){c[0]}+", f"{c[0]}+"), CLASSES, shape)


def generalised(loose: Column) -> Column:
    """The loose shape with its words as such; a text that is a number as a whole is one, whatever its sign and fraction."""
    return F.when(loose.rlike(r"\A(\\-)?9\+(\\\.9\+)?\z"), "№").otherwise(F.regexp_replace(loose, r"(?:A\+|a\+)+", "ω"))


def as_expression(shape: Column) -> Column:
    """A shape, tight, loose or general, as a regular expression for the whole text."""
    body = reduce(lambda s, c: F.regexp_replace(s, f"(?<!\\\\){c[0]}", c[1].replace("\\", "\\\\")), [(symbol, text) for symbol, text, _ in CLASSES], shape)
    body = reduce(lambda s, c: F.replace(s, F.lit(c[0]), F.lit(c[1])), ATOMS, body)
    return F.concat(F.lit(r"\A"), body, F.lit(r"\z"))


def as_class(symbols: Column) -> Column:
    """Any text of the given classes and literals."""
    inner = F.create_map(*[F.lit(x) for pair in INSIDE for x in pair])
    return F.concat(F.lit(r"\A["), F.array_join(F.transform(symbols, lambda x: F.coalesce(F.element_at(inner, x), x)), ""), F.lit(r"]+\z"))


def _length_bits(n: Column) -> Column:
    """The universal code that gives the length n the probability 1 / (n (n + 1))."""
    return F.log2(n * (n + F.lit(1.0)))


def shape_costs(shape: Column, general: Column) -> dict[str, Column]:
    """Bits of a shape's characters (``members``; ``in_words`` more where letters may be of either case), of its lengths, of
    its tight, loose and general form without lengths, of one value as any text, and how many characters it has."""
    count = lambda text, symbol: F.length(text) - F.length(F.replace(text, F.lit(symbol), F.lit("")))
    runs = lambda text, symbols: F.regexp_extract_all(text, F.lit(f"({symbols})"), F.lit(1))
    literals = lambda text: count(text, "\\") * (CLASS_BITS + LITERAL_BITS)
    plain = F.regexp_replace(shape, r"\\\\.", "\\\\")  # each literal as one backslash
    own_runs = runs(plain, "9+|A+|a+|ä+|␣+")
    general_runs = F.size(runs(F.regexp_replace(general, r"\\\\.", ""), "[9Aaä␣ω]"))
    return {
        "members": reduce(lambda a, b: a + b, [count(plain, symbol) * bits for symbol, _, bits in CLASSES]),
        "in_words": F.when(general.contains("ω"), (count(plain, "A") + count(plain, "a")) * WORD_MORE).otherwise(0.0),
        "lengths": F.aggregate(own_runs, F.lit(0.0), lambda total, r: total + _length_bits(F.length(r))),
        "code": F.size(own_runs) * CLASS_BITS + literals(shape),
        "general_code": general_runs * CLASS_BITS + count(general, "№") * NUMBER_BITS + literals(general),
        "any_value": F.length(plain) * ANY_BITS + _length_bits(F.greatest(F.length(plain), F.lit(1))), "chars": F.length(plain),
    }


def _symbols(shape: Column) -> Column:
    """The distinct classes and literals of a shape."""
    return F.array_distinct(F.regexp_extract_all(shape, F.lit(r"(?s)(\\.|[^\\])"), F.lit(1)))


def induce_expressions(shapes: DataFrame, keys: list[str], support: float = 0.05) -> DataFrame:
    """(column_name, shape, expression): the column's expression that takes the values of each shape, or null.

    ``shapes`` has ``keys`` (of a load), column_name, shape, ``d`` and ``n``, the numbers of distinct values and of rows. A
    load describes its values by forms. It pays for each form once, for each length that it sees under the form once, for
    saying which form a value has, and for the value's characters in their classes; a value under no form is any text.
    Forms generalise in steps: a shape, its runs of any length, its numbers and words as such, and one class of characters
    for all values. Bottom-up, a load weighs each form against the cheapest choice below it. What holds less than
    ``support`` of the rows of a form is noise that bends no choice: if one part below holds the rest, only that counts.

    The column takes, at each form, the choice of most of the loads that have it, so a load whose values are bad does not
    bend the expressions of the others. A form is an expression of the column only if it pays, and holds ``support`` of the
    rows, in more than half of all its loads. Nothing is collected: costs are sums over shapes, votes are counts over
    loads. No values, no rows.
    """
    costs = shape_costs(F.col("shape"), F.col("general"))
    level, at = ["column_name", "general", "loose"], [*keys, "column_name"]
    rows = shapes.where("shape is not null").select(*at, "shape", "d", "n", loosened(F.col("shape")).alias("loose"))
    rows = rows.withColumn("general", generalised(F.col("loose")))
    d, bits_of = F.col("d"), lambda d: d * F.log2(F.greatest(d, F.lit(1)))

    # The class of a column: the symbols that most of its loads have in ``support`` of their rows. At most ASCII's literals and the classes.
    totals = rows.groupBy(*at).agg(F.sum("n").alias("total"))
    loads = totals.groupBy("column_name").agg(F.count(F.lit(1)).alias("loads"))
    symbols = rows.select(*at, "n", F.explode(_symbols(F.col("shape"))).alias("symbol")).groupBy(*at, "symbol").agg(F.sum("n").alias("with"))
    symbols = salted_join(symbols, totals, at, F.col("symbol"), 8).where(F.col("with") >= support * F.col("total")).groupBy("column_name", "symbol").agg(F.count(F.lit(1)).alias("has"))
    member_bits = F.create_map(*[F.lit(x) for symbol, _, b in CLASSES for x in (symbol, b)])
    size = F.pow(F.lit(2.0), F.coalesce(F.element_at(member_bits, F.col("symbol")), F.lit(0.0)))
    usual = loads.join(symbols, "column_name").where(F.col("has") * 2 > F.col("loads"))
    charset = usual.groupBy("column_name").agg(F.sort_array(F.collect_list("symbol")).alias("charset"), F.log2(F.sum(size)).alias("char_bits"))
    charset = loads.join(charset, "column_name", "left").withColumn("charset", F.coalesce("charset", F.array().cast("array<string>")))
    charset_code = CLASS_BITS + F.size("charset") * CLASS_BITS + F.size(F.filter("charset", lambda x: x.startswith("\\"))) * LITERAL_BITS
    charset = charset.withColumn("charset_code", charset_code)

    priced = rows.select("*", *[c.cast("double").alias(k) for k, c in costs.items()]).join(charset.drop("loads"), "column_name")
    priced = salted_join(priced, totals, at, F.col("shape"), 8)
    inside = F.size(F.array_except(_symbols(F.col("shape")), "charset")) == 0
    as_class_bits = d * (F.col("chars") * F.col("char_bits") + _length_bits(F.greatest("chars", F.lit(1))))
    priced = priced.withColumn("any", d * F.col("any_value")).withColumn("values", F.col("lengths") + d * F.col("members"))
    priced = priced.withColumn("tight", F.col("code") + F.col("values")).withColumn("top", F.when(inside, as_class_bits).otherwise(F.col("any")))
    priced = priced.withColumn("wordy", F.col("values") + d * F.col("in_words")).withColumn("below", F.least("tight", "any"))
    priced = priced.withColumn("lengths_seen", F.lit(1).cast("bigint"))
    # Written once, as each of the steps below reads it: the next two sum within these partitions, then only votes move.
    priced = cut_lineage(priced.drop("chars", "char_bits", "any_value", "in_words", "members", "lengths").withColumn("inside", inside)).repartition(*at, "general")

    def summed(df: DataFrame, by: list[str], code: str) -> DataFrame:
        """The sums of a form over its parts, or those of the one part that holds nearly all of its rows."""
        parts = ["values", "wordy", "any", "below", "n", "d", "lengths_seen"]
        chief = F.max_by(F.struct(*parts), F.struct("n", "values")).alias("chief")
        out = df.groupBy(*by).agg(
            *[F.sum(c).alias(c) for c in parts], F.sum(bits_of(d)).alias("parts_bits"), chief, F.max(code).alias("code"), F.max("general_code").alias("general_code"),
            F.sum("top").alias("top"), F.max("charset_code").alias("charset_code"), F.max("total").alias("total"),
        )
        alone = F.col("chief.n") >= (1 - support) * F.col("n")
        counted = F.struct(*[F.when(alone, F.col(f"chief.{c}")).otherwise(F.col(c)).alias(c) for c in parts], F.when(alone, 0.0).otherwise(bits_of(d) - F.col("parts_bits")).alias("naming"))
        return out.withColumn("counted", counted)

    # Saying which length a value has costs the same as saying which shape, so it decides nothing between them; nor does
    # saying which sign and fraction a number has, beside saying which loose form.
    one = summed(priced, [*at, "general", "loose"], "code").withColumn("own", F.col("code") + F.col("counted.values")).withColumn("lower", F.col("counted.below"))
    one = one.withColumn("below", F.least(F.col("code") + F.col("values"), "below")).withColumn("lengths_seen", F.col("counted.lengths_seen"))
    two = summed(one, [*at, "general"], "general_code")
    is_number = F.col("general") == "№"
    # Values that are all as long pay for leaving the length open.
    left_open = F.when(F.col("counted.lengths_seen") == 1, F.log2(F.col("counted.d") + F.lit(1))).otherwise(0.0)
    two = two.withColumn("own", F.col("general_code") + left_open + F.when(is_number, F.col("counted.values")).otherwise(F.col("counted.wordy")))
    two = two.withColumn("lower", F.col("counted.below") + F.when(is_number, 0.0).otherwise(F.col("counted.naming")))
    two = two.withColumn("best", F.least(F.col("general_code") + F.col("wordy"), "below"))
    three = two.groupBy(*at).agg(
        (F.max("charset_code") + F.sum("top")).alias("own"), (F.sum("best") + bits_of(F.sum("d")) - F.sum(bits_of(d))).alias("lower"), F.sum("any").alias("any"), F.sum("n").alias("n"), F.max("total").alias("total"),
    )

    def votes(costs: DataFrame, by: list[str], name: str) -> DataFrame:
        """For each form, whether most loads that have it choose it over what is below, and in how many it pays."""
        pays = (F.col("own") < F.col("any")) & (F.col("n") >= support * F.col("total"))
        chosen = F.sum((F.col("own") < F.col("lower")).cast("int")) * 2 > F.count(F.lit(1))
        return costs.groupBy(*by).agg(chosen.alias(f"{name}_chosen"), F.sum(pays.cast("int")).alias(f"{name}_pays"))

    tight_pays = (F.col("tight") < F.col("any")) & (F.col("n") >= support * F.col("total"))
    tight = priced.groupBy(*level, "shape").agg(F.sum(tight_pays.cast("int")).alias("tight_pays"), F.max("inside").alias("inside"))
    by_loose, by_general = votes(one, level, "loose"), votes(two, ["column_name", "general"], "general")
    by_column = votes(three, ["column_name"], "top").join(charset.select("column_name", "charset", "loads"), "column_name")
    # A loose or general form has one row here and may have many shapes there: hot ones are spread over their shapes.
    found = salted_join(tight, by_loose, level, F.col("shape"), 8)
    found = salted_join(found, by_general, ["column_name", "general"], F.col("shape"), 8)
    found = salted_join(found, by_column, ["column_name"], F.col("shape"), 8)
    most = lambda pays: F.col(pays) * 2 > F.col("loads")
    chosen = (
        F.when(F.col("top_chosen"), F.when(F.col("inside") & most("top_pays"), as_class(F.col("charset"))))
        .when(F.col("general_chosen"), F.when(most("general_pays"), as_expression(F.col("general"))))
        .when(F.col("loose_chosen"), F.when(most("loose_pays"), as_expression(F.col("loose"))))
        .when(most("tight_pays"), as_expression(F.col("shape")))
    )
    return found.select("column_name", "shape", chosen.alias("expression"))


class LoadProfile:
    """Profile of ``columns`` of ``df`` for each load of each feed.

    The well-formed values of a text column are those that its induced expressions take; every value of another column is
    well-formed but NaN. ``numeric`` columns have ranges and medians of their well-formed numbers. Rows sent twice count
    twice; null feeds or loads form their own group; an empty table gives empty results.
    """

    def __init__(self, df: DataFrame, feed: str, load: str, columns: list[str], numeric: list[str] | None = None):
        if (absent := [c for c in [feed, load, *columns] if c not in df.columns]) or len(set(columns)) < len(columns):
            raise SchemaError(f"columns not there or named twice: {absent or columns}")
        self.df, self.keys, self.columns = df, [feed, load], columns
        self.text = [c for c in columns if isinstance(df.schema[c].dataType, StringType)]
        self.typed = [c for c in columns if c not in self.text]
        self.numeric = columns if numeric is None else numeric

    @cached_property
    def values(self) -> DataFrame:
        """(k0, k1, column_name, value, n, shape, number) of the text columns, written once: it is read several times."""
        counts = value_counts(self.df, self.keys, self.text)
        number = F.col("column_name").isin(self.numeric) & F.col("value").rlike(NUMBER)
        return cut_lineage(counts.withColumn("shape", shape_of(F.col("value"))).withColumn("number", F.when(number, F.col("value").try_cast("double"))))

    @cached_property
    def numbers(self) -> DataFrame:
        """(k0, k1, column_name, number, n): the distinct numbers of the columns that are numeric by type, written once."""
        typed = [c for c in self.typed if c in self.numeric and isinstance(self.df.schema[c].dataType, NumericType)]
        if not typed:
            return self.df.sparkSession.createDataFrame([], self._number_schema())
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), (quoted(c).cast("double") + F.lit(0.0)).alias("number")) for c in typed]))
        long = self.df.select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(self.keys)], cells.alias("cell")).select("k0", "k1", "cell.*")
        return cut_lineage(long.where("number is not null and not isnan(number)").groupBy("k0", "k1", "column_name", "number").agg(F.count(F.lit(1)).alias("n")))

    def _number_schema(self) -> str:
        kinds = [self.df.schema[k].dataType.simpleString() for k in self.keys]
        return f"k0 {kinds[0]}, k1 {kinds[1]}, column_name string, number double, n bigint"

    @cached_property
    def shapes(self) -> DataFrame:
        """(k0, k1, column_name, shape, n, d, lo, hi): rows, distinct values and numbers of each shape of a load."""
        by = ["k0", "k1", "column_name", "shape"]
        return cut_lineage(self.values.groupBy(*by).agg(F.sum("n").alias("n"), F.count("value").alias("d"), F.min("number").alias("lo"), F.max("number").alias("hi")))

    @cached_property
    def _forms(self) -> DataFrame:
        """(column_name, shape, expression) where a shape has an expression, written once."""
        return cut_lineage(self.expressions().where("expression is not null"))

    def expressions(self) -> DataFrame:
        """(column_name, shape, expression) over all loads, see induce_expressions."""
        return induce_expressions(self.shapes, ["k0", "k1"])

    def standard(self) -> DataFrame:
        """(feed, load, column_name, n_rows, n_missing, n_distinct, minimum, maximum): aggregates that need no expression.

        Rows, missing cells and the range of all numbers are one pass over the table as it is. Distinct values are counted
        as 64-bit numbers, those of texts as hashes. Numbers in text are cells of the form of NUMBER.
        """
        kinds = {c: self.df.schema[c].dataType for c in self.columns}
        text = {c: F.trim(quoted(c)) for c in self.text}
        there = {c: F.when(~text[c].isin("", "NA"), text[c]) if c in text else quoted(c) for c in self.columns}

        def number(c: str) -> Column:
            if c not in self.numeric or not (c in text or isinstance(kinds[c], NumericType)):
                return F.lit(None).cast("double")
            value = F.when(text[c].rlike(NUMBER), text[c].try_cast("double")) if c in text else quoted(c).cast("double")
            return F.when(~F.isnan(value), value)

        by = [quoted(k).alias(f"k{i}") for i, k in enumerate(self.keys)]
        # Worked out before they are aggregated: otherwise each aggregate does it again, in code too long to be compiled.
        worked = self.df.select(*by, *[x for i, c in enumerate(self.columns) for x in (there[c].isNotNull().alias(f"there{i}"), pinned(number(c)).alias(f"number{i}"))])
        facts = [F.count(F.lit(1)).alias("n")]
        for i in range(len(self.columns)):
            facts += [F.count_if(F.col(f"there{i}")).alias(f"there{i}"), F.min(f"number{i}").alias(f"lo{i}"), F.max(f"number{i}").alias(f"hi{i}")]
        wide = worked.groupBy("k0", "k1").agg(*facts)
        each = [F.struct(F.lit(i).cast("smallint").alias("c"), F.lit(c).alias("column_name"), F.col(f"there{i}").alias("there"), F.col(f"lo{i}").alias("minimum"), F.col(f"hi{i}").alias("maximum")) for i, c in enumerate(self.columns)]
        wide = wide.select("k0", "k1", F.col("n").alias("n_rows"), F.explode(F.array(*each)).alias("e")).select("k0", "k1", "n_rows", "e.*")

        # Whole numbers and doubles as they are (their bytes compress), all else by hash.
        as_long = lambda c: there[c].cast("bigint") if kinds[c].simpleString() in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(there[c])
        cells = [F.when(there[c].isNotNull(), F.struct(F.lit(i).cast("smallint").alias("c"), as_long(c).alias("v"))) for i, c in enumerate(self.columns)]
        long = self.df.select(*by, F.explode(F.array(*cells)).alias("x")).where("x is not null").select("k0", "k1", "x.c", "x.v")
        distinct = long.distinct().groupBy("k0", "k1", "c").agg(F.count(F.lit(1)).alias("n_distinct"))
        distinct = distinct.select(F.col("k0").alias("_k0"), F.col("k1").alias("_k1"), F.col("c").alias("_c"), "n_distinct")
        same = F.col("k0").eqNullSafe(F.col("_k0")) & F.col("k1").eqNullSafe(F.col("_k1")) & (F.col("c") == F.col("_c"))
        both = wide.join(distinct, same, "left")
        return both.select(
            F.col("k0").alias("feed"), F.col("k1").alias("load"), "column_name", "n_rows", (F.col("n_rows") - F.col("there")).alias("n_missing"),
            F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"), "minimum", "maximum",
        )

    def summary(self) -> DataFrame:
        """(feed, load, column_name, n_rows, n_missing, n_distinct, n_ill, n_conforming, minimum, maximum, has_negative).

        n_ill: rows not missing that no expression of the column takes (NaN in a typed column); n_conforming: the others.
        Ranges are those of well-formed numbers.
        """
        known = salted_join(self.shapes, self._forms.withColumn("formed", F.lit(True)).drop("expression"), ["column_name", "shape"], F.struct("k0", "k1"), 8, "left")
        formed, there = F.coalesce("formed", F.lit(False)), F.col("shape").isNotNull()
        out = known.groupBy("k0", "k1", "column_name").agg(
            F.sum("n").alias("n_rows"), F.sum(F.when(there, 0).otherwise(F.col("n"))).alias("n_missing"), F.sum("d").alias("n_distinct"),
            F.sum(F.when(there & ~formed, F.col("n")).otherwise(0)).alias("n_ill"), F.sum(F.when(there & formed, F.col("n")).otherwise(0)).alias("n_conforming"),
            F.min(F.when(formed, F.col("lo"))).alias("minimum"), F.max(F.when(formed, F.col("hi"))).alias("maximum"),
        ).withColumnsRenamed({"k0": "feed", "k1": "load"})
        if self.typed:
            typed = LoadProfile(self.df, *self.keys, self.typed, [c for c in self.numeric if c in self.typed]).standard()
            nan = [c for c in self.typed if self.df.schema[c].dataType.simpleString() in ("double", "float")]
            counts = [F.sum(F.isnan(quoted(c)).cast("bigint")).alias(f"nan{i}") for i, c in enumerate(nan)] or [F.lit(0).alias("nan")]
            ill = self.df.groupBy(*[quoted(k).alias(f"k{i}") for i, k in enumerate(self.keys)]).agg(*counts)
            entries = F.map_from_arrays(F.array(*[F.lit(c) for c in nan]).cast("array<string>"), F.array(*[F.coalesce(f"nan{i}", F.lit(0)) for i in range(len(nan))]).cast("array<bigint>"))
            ill = ill.select("k0", "k1", entries.alias("nan_of"))
            same = F.col("feed").eqNullSafe(F.col("k0")) & F.col("load").eqNullSafe(F.col("k1"))
            n_ill = F.coalesce(F.try_element_at("nan_of", F.col("column_name")), F.lit(0)).cast("bigint")
            typed = typed.join(ill, same, "left").withColumn("n_ill", n_ill).withColumn("n_conforming", F.col("n_rows") - F.col("n_missing") - F.col("n_ill"))
            out = out.unionByName(typed.select(*out.columns))
        return out.withColumn("has_negative", F.coalesce(F.col("minimum") < 0, F.lit(False)))

    def medians(self) -> DataFrame:
        """(feed, load, column_name, median) of the well-formed numbers."""
        columns = ["k0", "k1", "column_name", "number", "n"]
        in_text = salted_join(self.values.where("number is not null"), self._forms.select("column_name", "shape"), ["column_name", "shape"], F.struct("k0", "k1", "value"), 8)
        rows = in_text.select(*columns).unionByName(self.numbers.select(*columns))
        return exact_medians(rows, ["k0", "k1", "column_name"], "number", "n").withColumnsRenamed({"k0": "feed", "k1": "load"})

    def coverage_changes(self) -> DataFrame:
        """(feed, load, column_name, coverage, coverage_before): loads of which the expressions take a share of the cells not
        missing that differs by over 0.05 from the load before."""
        facts = self.summary().withColumn("there", F.col("n_rows") - F.col("n_missing"))
        order = Window.partitionBy("feed", "column_name").orderBy("load")
        facts = facts.select("*", *[F.lag(c).over(order).alias(f"was_{c}") for c in ("there", "n_conforming")])
        wide = lambda a, b: F.col(a).cast("decimal(18,0)") * F.col(b).cast("decimal(18,0)")
        differ = F.abs(wide("n_conforming", "was_there") - wide("was_n_conforming", "there")) * 20 > wide("there", "was_there")
        share = lambda a, b: (F.col(a) / F.col(b))
        found = facts.where((F.col("there") > 0) & (F.col("was_there") > 0) & differ)
        return found.select("feed", "load", "column_name", share("n_conforming", "there").alias("coverage"), share("was_n_conforming", "was_there").alias("coverage_before"))

    def distances(self, columns: list[str]) -> DataFrame:
        """(feed, load, column_name, shifted, scale): shifted / scale is half the sum, over all values, of the absolute
        differences between a load's shares and those of the load before; both whole numbers."""
        rows = self.values.where(F.col("column_name").isin(columns) & F.col("value").isNotNull()).select("k0", "k1", "column_name", "value", "n")
        order = Window.partitionBy("k0", "column_name").orderBy("k1")
        loads = self.values.where(F.col("column_name").isin(columns)).groupBy("k0", "k1", "column_name").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("own"))
        loads = loads.select("*", F.lag("own").over(order).alias("before"), F.lead("own").over(order).alias("after"), F.lead("k1").over(order).alias("next"), F.lead(F.lit(1)).over(order).alias("has_next"))
        joined = salted_join(rows, loads, ["k0", "k1", "column_name"], F.col("value"), 8)
        as_own = F.struct(F.col("k1").alias("load"), F.col("n").alias("now"), F.lit(0).cast("bigint").alias("then"), F.col("own").alias("total"), F.col("before").alias("was"))
        as_before = F.struct(F.col("next").alias("load"), F.lit(0).cast("bigint").alias("now"), F.col("n").alias("then"), F.col("after").alias("total"), F.col("own").alias("was"))
        both = joined.select(F.col("k0").alias("feed"), "column_name", "value", F.explode(F.array(as_own, F.when(F.col("has_next") == 1, as_before))).alias("e")).where("e is not null and e.total > 0 and e.was > 0")
        each = both.groupBy("feed", "e.load", "column_name", "value").agg(F.sum("e.now").alias("now"), F.sum("e.then").alias("then"), F.max("e.total").alias("total"), F.max("e.was").alias("was"))
        wide = lambda a, b: F.col(a).cast("decimal(18,0)") * F.col(b).cast("decimal(18,0)")
        return each.groupBy("feed", "load", "column_name").agg(F.sum(F.abs(wide("now", "was") - wide("then", "total"))).alias("shifted"), F.max(2 * wide("total", "was")).alias("scale"))

    def changes(self, categories: list[str]) -> DataFrame:
        """(feed, load, column_name, finding): how each load from the second of its feed on differs from the load before.

        ``null_share`` (missing shares differ by over 0.10), ``distinct_count`` (over twice the other), ``pattern`` (shares
        of ill-formed among those not missing differ by over 0.05), for numeric columns ``value_range`` (only one has a
        negative number, or a maximum over ten times the other) and ``distribution`` (a median over twice the other), for
        ``categories`` ``distribution`` (distances above 0.25). Shares are compared as whole-number products, so no
        rounding decides. Where a side has nothing to compare, that finding does not hold.
        """
        numeric = [c for c in self.numeric if c not in categories]
        facts = self.summary()
        keys = ["feed", "load", "column_name"]
        middle = self.medians().select(*[F.col(k).alias(f"m_{k}") for k in keys], "median")
        apart = self.distances(categories).select(*[F.col(k).alias(f"d_{k}") for k in keys], "shifted", "scale")
        same = lambda p: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{p}_{k}")) for k in keys])
        facts = facts.join(middle, same("m"), "left").join(apart, same("d"), "left")
        order = Window.partitionBy("feed", "column_name").orderBy("load")
        facts = facts.withColumn("there", F.col("n_rows") - F.col("n_missing"))
        was = lambda c: F.lag(c).over(order)
        compared = ["n_rows", "n_missing", "n_distinct", "n_ill", "there", "minimum", "maximum", "has_negative", "median"]
        facts = facts.select("*", *[was(c).alias(f"was_{c}") for c in compared]).where("was_n_rows is not null")
        wide = lambda a, b: F.col(a).cast("decimal(18,0)") * F.col(b).cast("decimal(18,0)")
        differ = lambda part, whole, times: F.abs(wide(part, f"was_{whole}") - wide(f"was_{part}", whole)) * times > wide(whole, f"was_{whole}")
        over = lambda c, times: (F.col(c) > times * F.col(f"was_{c}")) | (F.col(f"was_{c}") > times * F.col(c))
        is_number, is_category = F.col("column_name").isin(numeric), F.col("column_name").isin(categories)
        holds = {
            "null_share": differ("n_missing", "n_rows", 10),
            "distinct_count": over("n_distinct", 2),
            "pattern": (F.col("there") > 0) & (F.col("was_there") > 0) & differ("n_ill", "there", 20),
            "value_range": is_number & ((F.col("has_negative") != F.col("was_has_negative")) | F.coalesce(over("maximum", 10), F.lit(False))),
            "distribution": F.coalesce(is_number & over("median", 2), F.lit(False)) | F.coalesce(is_category & (F.col("shifted") * 4 > F.col("scale")), F.lit(False)),
        }
        findings = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in holds.items()]), lambda f: f.isNotNull())
        return facts.select("feed", "load", "column_name", F.explode(findings).alias("finding"))
