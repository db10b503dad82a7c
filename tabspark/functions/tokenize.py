"""One line of delimited text as an array of tokens, in one expression.

A quote opens a quoted token only as its very first character and closes it only right before a separator or the end of
the line; what is between may hold separators and bare quotes, and doubled quotes become one. A quoted token without end
takes the rest of the line. Other tokens lose outer white space. Quoted line breaks do not exist.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabspark.sources.options import NoQuoting, ParserOptions


def _literal(text: str) -> str:
    """A Java pattern for the text itself."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def tokens_of(line: Column, options: ParserOptions) -> Column:
    """The tokens of a line. With NoQuoting it is only split at the separator, and nothing is stripped."""
    sep = _literal(options.separator)
    if isinstance(options.quoting, NoQuoting):
        return F.split(line, sep, -1)
    mark = options.quoting.quote
    q, end = _literal(mark), rf"(?={sep}|\z)"
    pattern = rf"(?s){sep}({q}{end}|{q}.*?{q}{end}|{q}.*\z|(?!{q}).*?{end})"

    def finish(token: Column) -> Column:
        inner = F.substring(token, F.lit(2), F.length(token))
        inner = F.when(inner.endswith(mark), F.substring(inner, F.lit(1), F.length(inner) - 1)).otherwise(inner)
        bare = F.when(token.rlike(r"(?U)\A\s|\s\z"), F.regexp_replace(token, r"(?U)\A\s+|\s+\z", "")).otherwise(token)
        return F.when(token.startswith(mark), F.replace(inner, F.lit(mark * 2), F.lit(mark))).otherwise(bare)

    # With a separator in front every token has one, so no match is empty.
    careful = F.transform(F.regexp_extract_all(F.concat(F.lit(options.separator), line), F.lit(pattern), F.lit(1)), finish)
    # Without a quote a line is only split, and stripped where a token has outer white space.
    padded = line.rlike(rf"(?U)\A\s|\s\z|{sep}\s|\s{sep}")
    return F.when(line.contains(mark) | padded, careful).otherwise(F.split(line, sep, -1))
