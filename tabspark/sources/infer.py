"""Column types from the first lines of a file: a fold, in line order, over the lattice of types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import SchemaError
from tabspark.functions.parsing import CATEGORICAL, PRIORITY, TEXT, UNSURE, Categorical, ParseType, categorical
from tabspark.session import quoted
from tabspark.sources.options import ParserOptions, RowGen, accessor, identifier
from tabspark.sources.text import files_of, read_tokens


@dataclass(frozen=True)
class Guess:
    """What is known of a column: a type's name, its place in the lattice, and what its cells so far hold: the levels of a
    categorical, or the distinct tokens of a type that combines cells by a function of its own."""

    name: str
    rank: int
    levels: frozenset[str] = frozenset()


SURELY_TEXT = Guess("Text", PRIORITY["Text"])
MAYBE_TEXT = Guess("Text", UNSURE)


def join_guesses(a: Guess, b: Guess, most: int | None, combine: dict[str, Callable[[frozenset[str]], bool]] | None = None) -> Guess:
    """The lower rank wins. Equal ranks keep an equal type, categoricals up to ``most`` levels, types with a ``combine`` as
    long as it holds for all tokens seen; all else is text.
    """
    if a.rank != b.rank:
        return a if a.rank < b.rank else b
    if a.name != b.name:
        return SURELY_TEXT
    levels = a.levels | b.levels
    if a.rank == CATEGORICAL:
        return Guess(a.name, CATEGORICAL, levels) if most is None or len(levels) <= most else SURELY_TEXT
    if combine and a.name in combine:
        return Guess(a.name, a.rank, levels) if combine[a.name](levels) else SURELY_TEXT
    return a


def guess_of(token: str, first_fit: int, universe: tuple[ParseType | Categorical, ...], sure: bool = True) -> Guess:
    """What one token says, given the place in the universe of the first type that it fits (-1: none).

    A type that is not sure of the token ranks behind all sure ones.
    """
    if token in ("", "NA") or first_fit < 0:
        return MAYBE_TEXT
    kind = universe[first_fit]
    if isinstance(kind, Categorical):
        return Guess(kind.name, CATEGORICAL, frozenset([token]))
    return Guess(kind.name, kind.priority + (0 if sure else UNSURE), frozenset([token]) if kind.combine else frozenset())


@dataclass(frozen=True)
class TableSpec:
    """The result of inference: column names, one type each, and the options that parse the file."""

    names: tuple[str, ...]
    types: tuple[ParseType, ...]
    options: ParserOptions
    row_name: str = "Row"
    prefix: str = ""

    @property
    def schema(self) -> T.StructType:
        fields = zip(self.names, self.types, strict=True)
        return T.StructType([T.StructField(n, t.spark_type, True, {"identifier": identifier(n, self.prefix), "parse_type": t.name, **t.metadata}) for n, t in fields])

    @property
    def columns(self) -> SimpleNamespace:
        """The columns as attributes, by their identifiers in lower case."""
        return SimpleNamespace(**{accessor(n, self.prefix): quoted(n) for n in self.names})

    def with_column(self, name: str, kind: ParseType) -> TableSpec:
        """Another type for one column, or a further column at the end."""
        if name in self.names:
            return replace(self, types=tuple(kind if n == name else t for n, t in zip(self.names, self.types, strict=True)))
        return replace(self, names=(*self.names, name), types=(*self.types, kind))


def declare(name: str, kind: ParseType, prefix: str = "") -> T.StructField:
    """A column declared by hand."""
    return T.StructField(name, kind.spark_type, True, {"identifier": identifier(name, prefix), "parse_type": kind.name, **kind.metadata})


def table_spec(columns: dict[str, ParseType], options: ParserOptions = ParserOptions(), row_name: str = "Row", prefix: str = "") -> TableSpec:
    """A spec written by hand."""
    return TableSpec(tuple(columns), tuple(columns.values()), options, row_name, prefix)


def _first_tokens(spark: SparkSession, path: str, gen: RowGen, most: int, *more: Column) -> list[Row]:
    """The tokens (and ``more`` columns) of the first ``most`` lines of a file or folder: files in the order of their paths,
    lines in the order of the file. Of a header line that each file has, only that of the first file with lines counts.
    """
    found: list[Row] = []
    for file in files_of(spark, path):
        again = bool(found) and not gen.names
        tokens = gen.token_reader(spark, file) if gen.token_reader else read_tokens(spark, file, gen.options)
        # A file's first split is its first task, so these are its first lines.
        found += tokens.select("tokens", *more).limit(most - len(found) + again).collect()[again:]
        if len(found) >= most:
            break
    return found


def infer_table(spark: SparkSession, path: str, gen: RowGen = RowGen()) -> TableSpec:
    """The columns of a file or folder by its first ``gen.lines`` lines. Only these few lines come to the driver, in order.

    In a folder every file has the header line (or none has, if ``gen.names`` are given); the prefix goes on from file to
    file until it is full. The shortest line decides how many columns have a type; if the header has another number,
    SchemaError is raised, as it is for a file without lines. A column of only blank and ``NA`` cells is text.
    """
    if gen.lines < 1:
        raise SchemaError("no lines to infer from")

    def first_fit(x):  # noqa: ANN001, ANN202
        tests = [F.lit(True) if isinstance(t, Categorical) else t.parse(x).isNotNull() for t in gen.universe]
        return reduce(lambda rest, n: F.when(tests[n], F.lit(n)).otherwise(rest), reversed(range(len(tests))), F.lit(-1))

    def surely(x):  # noqa: ANN001, ANN202
        """Whether the first type that fits is sure of the token."""
        tests = [(t.parse(x).isNotNull(), t.sure(x)) for t in gen.universe if not isinstance(t, Categorical) and t.sure]
        return reduce(lambda rest, t: F.when(t[0], t[1]).otherwise(rest), reversed(tests), F.lit(True))

    columns = [F.transform("tokens", first_fit).alias("fits"), F.transform("tokens", surely).alias("sure")]
    seen = _first_tokens(spark, path, gen, gen.lines, *columns)
    if not seen:
        raise SchemaError(f"{path} has no lines")
    names, rows = (tuple(gen.names), seen) if gen.names else (tuple(seen[0].tokens), seen[1:])
    if len(set(names)) < len(names):
        raise SchemaError(f"column names come twice: {names}")
    most = next((t.most for t in gen.universe if isinstance(t, Categorical)), None)
    combine = {t.name: t.combine for t in gen.universe if isinstance(t, ParseType) and t.combine}
    guesses: list[Guess] = []
    for n, row in enumerate(rows):
        own = [guess_of(token, fit, gen.universe, sure) for token, fit, sure in zip(row.tokens, row.fits, row.sure, strict=True)]
        guesses = own if n == 0 else [join_guesses(a, b, most, combine) for a, b in zip(guesses, own, strict=False)]
    if len(guesses) != len(names):
        raise SchemaError(f"{len(names)} column names, but {len(guesses)} columns in the shortest of the first lines")
    known = {t.name: t for t in gen.universe if isinstance(t, ParseType)}
    types = tuple(categorical(identifier(n), sorted(g.levels)) if g.rank == CATEGORICAL else known.get(g.name, TEXT) for n, g in zip(names, guesses, strict=True))
    return TableSpec(names, types, gen.options, gen.row_name, gen.prefix)


def text_table(spark: SparkSession, path: str, gen: RowGen = RowGen()) -> TableSpec:
    """All columns as text, by the header line of the first file (or the given names) alone."""
    if gen.names:
        return TableSpec(tuple(gen.names), (TEXT,) * len(gen.names), gen.options, gen.row_name, gen.prefix)
    first = _first_tokens(spark, path, gen, 1)
    if not first:
        raise SchemaError(f"{path} has no lines")
    return TableSpec(tuple(first[0].tokens), (TEXT,) * len(first[0].tokens), gen.options, gen.row_name, gen.prefix)
