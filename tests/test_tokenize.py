"""The tokenizer expression against a plain model of its rules."""

import random

from pyspark.sql import functions as F

from tabspark.functions.tokenize import tokens_of
from tabspark.sources.options import NoQuoting, ParserOptions, RFC4180Quoting


def model(line, sep=",", quote='"'):
    parts, out, n = line.split(sep), [], 0
    while n < len(parts):
        part = parts[n]
        n += 1
        if part == "":
            out.append("")
        elif not part.startswith(quote):
            out.append(part.strip())
        else:
            if part.endswith(quote):
                body = part[1:-1]
            else:
                held = [part[1:]]
                closed = False
                while n < len(parts) and not closed:
                    held.append(parts[n])
                    closed = parts[n].endswith(quote)
                    n += 1
                body = sep.join(held)
                body = body[: -len(quote)] if closed else body
            out.append(body.replace(quote * 2, quote))
    return out


def tokenized(spark, lines, options):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    return [r.t for r in df.select("i", tokens_of(F.col("value"), options).alias("t")).orderBy("i").collect()]


def test_named_cases(spark):
    cases = {
        "": [""],
        "a,b": ["a", "b"],
        " a ,  b\t": ["a", "b"],
        '" a ",b': [" a ", "b"],
        '"a,b",c': ["a,b", "c"],
        '"a"",b"': ['a"', 'b"'],
        'x,"MUSSER, B W "B"",y': ["x", 'MUSSER, B W "B"', "y"],
        'x,"never, closed': ["x", "never, closed"],
        '"': [""],
        '""': [""],
        'a"b,c': ['a"b', "c"],
        "a,": ["a", ""],
        ",": ["", ""],
    }
    assert tokenized(spark, list(cases), ParserOptions()) == list(cases.values())


def test_random_lines(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice('a,"" b') for _ in range(rng.randrange(14))) for _ in range(4000)]
    assert tokenized(spark, lines, ParserOptions()) == [model(x) for x in lines]


def test_other_separators_and_quotes(spark):
    rng = random.Random(6)
    lines = ["".join(rng.choice("a|'; b") for _ in range(rng.randrange(14))) for _ in range(1500)]
    assert tokenized(spark, lines, ParserOptions(separator="|", quoting=RFC4180Quoting("'"))) == [model(x, "|", "'") for x in lines]
    assert tokenized(spark, ["a||b| c||", "||"], ParserOptions(separator="||")) == [["a", "b| c", ""], ["", ""]]


def test_without_quoting_nothing_is_changed(spark):
    assert tokenized(spark, [' a ,"b', ""], ParserOptions(quoting=NoQuoting())) == [[" a ", '"b'], [""]]


def test_long_and_null_lines(spark):
    long = "x" * 300_000
    got = tokenized(spark, [f'"{long},{long}",1', None, '"' + "a," * 50_000], ParserOptions())
    assert got[0] == [f"{long},{long}", "1"] and got[1] is None and got[2] == ["a," * 50_000]
