"""Typed parsing of text cells: a registry of types, each a guarded Spark expression that is null where the text does not fit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Places in the order of types in inference; the lowest wins. Unlisted types count as custom.
PRIORITY = {"Text": 0, "Double": 2, "Int": 3, "Bool": 4}
CUSTOM, UNSURE, CATEGORICAL = 5, 6, 7


@dataclass(frozen=True)
class ParseType:
    """A column type: its name, Spark type, and the parse of a text column (null: does not fit).

    ``sure`` says whether a text that fits surely is of the type (None: always); in inference a column of cells that only
    may be of it becomes the type unless a cell surely is of another. ``combine`` says whether all the texts seen so far,
    each of which fits, can be one column of the type (None: they can); if not, the column is text.
    """

    name: str
    spark_type: T.DataType
    parse: Callable[[Column], Column] = field(compare=False)
    metadata: dict = field(default_factory=dict, compare=False)
    sure: Callable[[Column], Column] | None = field(default=None, compare=False)
    combine: Callable[[frozenset[str]], bool] | None = field(default=None, compare=False)

    @property
    def priority(self) -> int:
        return PRIORITY.get(self.name, CUSTOM)


@dataclass(frozen=True)
class Categorical:
    """In a universe: any text, as long as a column has at most ``most`` different ones."""

    most: int = 8
    name: str = "Categorical"


def whole_number(kind: str) -> Callable[[Column], Column]:
    """A sign and digits, with one ``.0`` at the end allowed; null beyond the type's range."""

    def parse(text: Column) -> Column:
        return F.when(text.rlike(r"\A[+-]?[0-9]+(\.0)?\z"), F.regexp_replace(text, r"\.0\z", "").try_cast(kind))

    return parse


def real_number(kind: str) -> Callable[[Column], Column]:
    """A decimal number with all commas removed, thousands marks or not; an exponent is allowed."""

    def parse(text: Column) -> Column:
        bare = F.replace(text, F.lit(","), F.lit(""))
        return F.when(bare.rlike(r"\A[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"), bare.try_cast(kind))

    return parse


def truth_value(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low == "true", True).when(low == "false", False)


BOOL = ParseType("Bool", T.BooleanType(), truth_value)
INT = ParseType("Int", T.LongType(), whole_number("bigint"))
INT32 = ParseType("Int32", T.IntegerType(), whole_number("int"))
INT64 = ParseType("Int64", T.LongType(), whole_number("bigint"))
INTEGER = ParseType("Integer", T.DecimalType(38, 0), whole_number("decimal(38,0)"))
FLOAT = ParseType("Float", T.FloatType(), real_number("float"))
DOUBLE = ParseType("Double", T.DoubleType(), real_number("double"))
TEXT = ParseType("Text", T.StringType(), lambda text: text)

COMMON = (BOOL, INT, DOUBLE, TEXT)
COMMON_CATEGORICAL = (BOOL, INT, DOUBLE, Categorical(8), TEXT)


def code_type(levels: int) -> T.DataType:
    """The narrowest integer type that numbers so many levels from 0."""
    return T.ByteType() if levels <= 128 else T.ShortType() if levels <= 32_768 else T.IntegerType()


def categorical(name: str, levels: list[str]) -> ParseType:
    """A type of the given levels, in their order; any other text does not fit. The levels are kept as column metadata."""
    return ParseType(name, T.StringType(), lambda text: F.when(text.isin(levels), text), {"levels": list(levels)})


def level_code(value: Column, levels: list[str]) -> Column:
    """The place of a level from 0, in the narrowest type. Compare codes, not texts, where the levels' order counts."""
    codes = F.create_map(*[F.lit(x) for i, level in enumerate(levels) for x in (level, i)])
    return F.element_at(codes, value).cast(code_type(len(levels)))


def level_of(code: Column, levels: list[str]) -> Column:
    """The level with that code; null for codes out of range."""
    return F.get(F.array(*map(F.lit, levels)), code.cast("int"))


ZIP_FIELDS = T.StructType([T.StructField("country", T.StringType()), T.StructField("digits", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])


def _zip(text: Column) -> Column:
    digits = F.transform(F.split(text, ""), lambda c: c.try_cast("int"))
    us = F.struct(F.lit("US").alias("country"), digits.alias("digits"), F.lit(None).cast("string").alias("text"))
    world = F.struct(F.lit("World").alias("country"), F.lit(None).cast("array<int>").alias("digits"), text.alias("text"))
    return F.when(F.char_length(text) == 5, F.when(text.rlike(r"\A[0-9]{5}\z"), us).otherwise(world))


#: An example of a custom type: five digits, or any other five characters.
ZIP = ParseType("Zip", ZIP_FIELDS, _zip)


def zoned_time(zone: str) -> ParseType:
    """A custom type for one zone: ``2015-01-02 03:04:05`` or ``2015-01-02`` in local time, as the time in UTC."""

    def parse(text: Column) -> Column:
        full = F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
        day = F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.coalesce(full, day).cast("timestamp_ntz"))

    return ParseType(f"TimeIn {zone}", T.TimestampNTZType(), parse, {"zone": zone})
