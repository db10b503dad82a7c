"""How a delimited file is read, and the identifiers of its columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tabspark.functions.parsing import COMMON, COMMON_CATEGORICAL, Categorical, ParseType


@dataclass(frozen=True)
class NoQuoting:
    """Lines are only split."""


@dataclass(frozen=True)
class RFC4180Quoting:
    """Tokens may be quoted by this character."""

    quote: str = '"'


QuotingMode = NoQuoting | RFC4180Quoting


@dataclass(frozen=True)
class ParserOptions:
    """``header``: the columns' names, if the file has no header line. ``encoding``: of the file, if not UTF-8.

    With ``ignore_quoting`` the readers of whole files quote by ``"`` whatever ``quoting`` says; parsing lines heeds it.
    """

    header: tuple[str, ...] | None = None
    separator: str = ","
    quoting: QuotingMode = RFC4180Quoting()
    encoding: str | None = None
    ignore_quoting: bool = False


TokenReader = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class RowGen:
    """Everything that schema inference needs to know.

    ``names`` replace a header line; ``prefix`` starts the columns' identifiers; ``universe`` lists the types that cells
    may have, in the order they are tried; ``lines`` is the number of lines looked at, a header line included;
    ``token_reader`` reads the file instead of the own tokenizer: it gives a column ``tokens``, the header as first row.
    """

    names: tuple[str, ...] = ()
    prefix: str = ""
    separator: str = ","
    quoting: QuotingMode = RFC4180Quoting()
    encoding: str | None = None
    row_name: str = "Row"
    universe: tuple[ParseType | Categorical, ...] = COMMON
    lines: int = 1000
    token_reader: TokenReader | None = field(default=None, compare=False)

    @property
    def options(self) -> ParserOptions:
        return ParserOptions(self.names or None, self.separator, self.quoting, self.encoding)


def categorical_row_gen(**changes) -> RowGen:  # noqa: ANN003
    """A RowGen whose universe has small categoricals."""
    return RowGen(**{"universe": COMMON_CATEGORICAL, **changes})


def with_types(*types: ParseType | Categorical) -> tuple[ParseType | Categorical, ...]:
    """The usual universe with further types that are tried first."""
    return (*types, *COMMON)


RESERVED = ("Type", "Class")


def identifier(name: str, prefix: str = "") -> str:
    """A capitalised identifier for a column name: letters, digits, quotes and underscores of its words.

    What does not start with a letter, is empty, or is a reserved word gets ``Col`` in front.
    """
    words, word = [], ""
    for c in name:
        if c.isalnum():
            word += c
        else:
            words.append(word)
            word = ""
    joined = "".join(w[:1].upper() + w[1:] for w in [*words, word])
    if not joined[:1].isalpha() or joined in RESERVED:
        joined = "Col" + joined
    return prefix + joined


def accessor(name: str, prefix: str = "") -> str:
    """The identifier with its first letter in lower case, as functions are called."""
    ident = identifier(name, prefix)
    return ident[:1].lower() + ident[1:]
