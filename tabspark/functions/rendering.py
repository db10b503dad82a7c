"""How values are written: plainly in delimited files, and as literals on screen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def show_double(value: Column) -> Column:
    """Shortest digits: plain from 0.1 to below ten million, else one digit, the rest, and the power of ten after ``e``."""
    text = value.cast("string")
    digits = F.regexp_extract(text, r"^-?0\.0*([1-9][0-9]*)$", 1)
    zeros = F.length(F.regexp_extract(text, r"^-?0\.(0*)[1-9]", 1))
    sign = F.when(value < 0, "-").otherwise("")
    rest = F.substring(digits, F.lit(2), F.length(digits))
    small = F.concat(sign, F.substring(digits, 1, 1), F.lit("."), F.when(rest == "", "0").otherwise(rest), F.lit("e-"), (zeros + 1).cast("string"))
    return F.when((F.abs(value) < 0.1) & (value != 0) & (digits != ""), small).otherwise(F.regexp_replace(text, "E", "e"))


def show_plain(value: Column, kind: T.DataType) -> Column:
    """A cell of a delimited file: text as it is, truth values capitalised, numbers by their digits. Nothing is quoted."""
    if isinstance(kind, T.BooleanType):
        return F.when(value, "True").otherwise("False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return show_double(value)
    return value.cast("string")


def show_literal(value: Column, kind: T.DataType) -> Column:
    """A cell on screen: as show_plain, but text in quotes with its special characters escaped."""
    if not isinstance(kind, T.StringType):
        return show_plain(value, kind)
    # Characters with an escape of their own.
    named = {"\a": "a", "\b": "b", "\t": "t", "\n": "n", "\v": "v", "\f": "f", "\r": "r", '"': '"', "\\": "\\"}
    escapes = F.create_map(*[F.lit(x) for c, name in named.items() for x in (c, "\\" + name)])
    mark = "\ue000"  # after a numbered escape; kept as an empty escape where a digit follows

    def one(c: Column) -> Column:
        code = F.ascii(c)
        return F.when(F.map_contains_key(escapes, c), F.element_at(escapes, c)).when((code > 126) | (code < 32), F.concat(F.lit("\\"), code.cast("string"), F.lit(mark))).otherwise(c)

    inner = F.array_join(F.transform(F.split(value, ""), one), "")
    inner = F.regexp_replace(F.regexp_replace(inner, f"{mark}(?=[0-9])", r"\\&"), mark, "")
    plain = value.rlike(r'\A[ !#-\[\]-~]*\z')
    return F.concat(F.lit('"'), F.when(plain, value).otherwise(inner), F.lit('"'))
