"""Values that are one of several columns: a struct with the column's name as ``tag`` and one nullable slot for each type.

The variant is known by its tag, which is a column name; columns of the same type share a slot.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import SchemaError
from tabspark.functions.rendering import show_literal
from tabspark.session import quoted


class Variants:
    """The variants that a tagged value may be, in order, and the slots of its struct."""

    def __init__(self, fields: list[T.StructField]):
        if len({f.name for f in fields}) < len(fields):
            raise SchemaError("variants have different names")
        self.fields = fields
        self.slots: dict[str, T.DataType] = {}
        for f in fields:
            self.slots.setdefault(self._slot(f.dataType), f.dataType)

    @staticmethod
    def _slot(kind: T.DataType) -> str:
        # Slot names of the usual types.
        return {"bigint": "int", "string": "text", "boolean": "bool"}.get(kind.simpleString(), kind.simpleString())

    @property
    def spark_type(self) -> T.StructType:
        return T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(s, k) for s, k in self.slots.items()]])

    def slot_of(self, tag: str) -> str:
        found = [f for f in self.fields if f.name == tag]
        if not found:
            raise SchemaError(f"no variant {tag!r}")
        return self._slot(found[0].dataType)

    def make(self, tag: str, value: Column) -> Column:
        """A tagged value."""
        own = self.slot_of(tag)
        return F.struct(F.lit(tag).alias("tag"), *[(value if s == own else F.lit(None)).cast(k).alias(s) for s, k in self.slots.items()])

    def as_tag(self, value: Column, tag: str) -> Column:
        """The content, if it is that variant, else null."""
        return F.when(value["tag"] == tag, value[self.slot_of(tag)])

    def as_type(self, value: Column, slot: str) -> Column:
        """The content, if it is of that slot's type, else null."""
        if slot not in self.slots:
            raise SchemaError(f"no variant of type {slot}")
        return value[slot]

    def match(self, value: Column, handlers: dict[str, Callable[[Column], Column]]) -> Column:
        """The handler of the variant, applied to the content. There must be one for every variant."""
        if set(handlers) != {f.name for f in self.fields}:
            raise SchemaError(f"handlers for {sorted(handlers)}, variants {[f.name for f in self.fields]}")
        return reduce(lambda rest, f: F.when(value["tag"] == f.name, handlers[f.name](value[self.slot_of(f.name)])).otherwise(rest), reversed(self.fields), F.lit(None))

    def on_content(self, value: Column, function: Callable[[Column], Column]) -> Column:
        """One function for the content of any variant; its results must have a common type."""
        return self.match(value, {f.name: function for f in self.fields})

    def map(self, value: Column, functions: dict[str, Callable[[Column], Column]]) -> Column:
        """The same variant with each slot changed by its function, by slot name; types stay."""
        parts = [functions.get(s, lambda c: c)(value[s]).cast(k).alias(s) for s, k in self.slots.items()]
        return F.when(value["tag"].isNotNull(), F.struct(value["tag"].alias("tag"), *parts))

    def to_row(self, value: Column) -> Column:
        """A struct with one nullable column for each variant."""
        return F.struct(*[self.as_tag(value, f.name).alias(f.name) for f in self.fields])

    def equal(self, a: Column, b: Column) -> Column:
        """Same variant and same content."""
        return a.eqNullSafe(b)

    def show(self, value: Column) -> Column:
        """``(Col {name :-> content})`` style text: the tag and the content as a literal."""
        inner = reduce(lambda rest, f: F.when(value["tag"] == f.name, show_literal(value[self.slot_of(f.name)], f.dataType)).otherwise(rest), reversed(self.fields), F.lit(None).cast("string"))
        return F.concat(value["tag"], F.lit(" :-> "), inner)


def variants_of(schema: T.StructType, names: list[str]) -> Variants:
    return Variants([schema[n] for n in names])


def fold_fields(names: list[str], zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A left fold over the named columns of a row."""
    return reduce(lambda acc, n: step(acc, quoted(n)), names, zero)


def fold_fields1(names: list[str], step: Callable[[Column, Column], Column]) -> Column:
    """As fold_fields, from the first column on."""
    return reduce(lambda acc, n: step(acc, quoted(n)), names[1:], quoted(names[0]))


def first_field(schema: T.StructType, names: list[str]) -> Column:
    """The first of the columns that is not null, tagged; null if all are."""
    kinds = variants_of(schema, names)
    return F.coalesce(*[F.when(quoted(n).isNotNull(), kinds.make(n, quoted(n))) for n in names])


def last_field(schema: T.StructType, names: list[str]) -> Column:
    """The last of the columns that is not null, tagged; null if all are."""
    kinds = variants_of(schema, names)
    return F.coalesce(*[F.when(quoted(n).isNotNull(), kinds.make(n, quoted(n))) for n in reversed(names)])
