"""Inference, the four failure policies, header lines, encodings, and writing."""

import os

import pytest
from pyspark.sql import functions as F

from tabspark.errors import SchemaError
from tabspark.functions import parsing as P
from tabspark.functions.rendering import show_double, show_literal
from tabspark.sinks import dsv
from tabspark.sources import infer, options, readers, text
from tabspark.sources.memory import boxed_frame, empty_frame, to_frame

MANAGERS = 'id,manager,age,pay\n1,Joe,53,"80,000"\n2,Sarah,44,"80,000"\n'


def kinds(spec):
    return [t.name for t in spec.types]


def test_infers_numbers_text_and_commas(spark, lines_file):
    spec = infer.infer_table(spark, lines_file(MANAGERS))
    assert spec.names == ("id", "manager", "age", "pay")
    assert kinds(spec) == ["Int", "Text", "Int", "Double"]
    assert [tuple(r) for r in readers.read_table(spark, lines_file(MANAGERS), spec).collect()] == [(1, "Joe", 53, 80000.0), (2, "Sarah", 44, 80000.0)]


@pytest.mark.parametrize(
    ("cells", "kind"),
    [
        (["1", "2", "3.0"], "Int"),
        (["1,000.00", "300", "0"], "Double"),
        (["0", "0", "A"], "Text"),
        (["true", "False"], "Bool"),
        (["true", "1"], "Int"),
        (["1", "2.5", "true"], "Double"),
        (["0", "", "1", "NA"], "Int"),
        (["", "NA"], "Text"),
        (["1e5", "2"], "Double"),
        (["99999999999999999999"], "Double"),
    ],
)
def test_lattice(spark, lines_file, cells, kind):
    quoted = ['"' + c + '"' for c in cells]
    for order in (quoted, quoted[::-1]):
        assert kinds(infer.infer_table(spark, lines_file("x\n" + "\n".join(order) + "\n"))) == [kind]


def test_categoricals_depend_on_order_and_number(spark, lines_file):
    gen = options.categorical_row_gen()
    months = ["may", "june", "may", "april"]
    spec = infer.infer_table(spark, lines_file("m\n" + "\n".join(months) + "\n"), gen)
    assert spec.types[0].metadata["levels"] == ["april", "june", "may"]
    many = [f"s{i}" for i in range(9)]
    assert kinds(infer.infer_table(spark, lines_file("m\n" + "\n".join(many) + "\n"), gen)) == ["Text"]
    assert kinds(infer.infer_table(spark, lines_file("m\n" + "\n".join(["1", *many]) + "\n"), gen)) == ["Int"]
    assert kinds(infer.infer_table(spark, lines_file("m\n" + "\n".join([*many, "1"]) + "\n"), gen)) == ["Text"]
    assert kinds(infer.infer_table(spark, lines_file("m,n\na,1\n,2\n"), gen)) == ["Text", "Int"]


def test_prefix_counts_the_header(spark, lines_file):
    path = lines_file("x\n1\n2\nthree\n")
    assert kinds(infer.infer_table(spark, path, options.RowGen(lines=3))) == ["Int"]
    assert kinds(infer.infer_table(spark, path, options.RowGen(lines=4))) == ["Text"]


def test_custom_types(spark, lines_file):
    path = lines_file("zip,when\n12345,2015-07-01 10:00:00\nK1A0B,2015-01-02\n")
    spec = infer.infer_table(spark, path, options.RowGen(universe=options.with_types(P.ZIP, P.zoned_time("America/Chicago"))))
    assert kinds(spec) == ["Zip", "TimeIn America/Chicago"]
    rows = readers.read_table(spark, path, spec).collect()
    assert rows[0].zip.digits == [1, 2, 3, 4, 5] and rows[1].zip.text == "K1A0B"
    assert [str(r.when) for r in rows] == ["2015-07-01 15:00:00", "2015-01-02 06:00:00"]


def test_two_custom_types_make_text(spark, lines_file):
    path = lines_file("x\nabcde\n2015-01-02\n")
    assert kinds(infer.infer_table(spark, path, options.RowGen(universe=options.with_types(P.ZIP, P.zoned_time("UTC"))))) == ["Text"]


def test_width_errors(spark, lines_file):
    broken = 'RowNum,Description,X,Y\n1,"two\nlines",3,4\n2,one,3,4\n'
    for bad in (broken, "a,b\n1\n", "", "a,a\n1,2\n"):
        with pytest.raises(SchemaError):
            infer.infer_table(spark, lines_file(bad))


def test_line_breaks_by_another_reader(spark, lines_file):
    path = lines_file('RowNum,Description,X,Y\n1,"two\nlines",3,4\n2,one,3,4\n')
    gen = options.RowGen(token_reader=lambda s, p: text.rfc4180_tokens(s, p, 4))
    spec = infer.infer_table(spark, path, gen)
    assert kinds(spec) == ["Int", "Text", "Int", "Int"]
    got = readers.parse_strict(text.rfc4180_tokens(spark, path, 4), spec).orderBy("RowNum").collect()
    assert [r.Description for r in got] == ["two\nlines", "one"]


def test_header_override_and_empty_name(spark, lines_file):
    headed, bare = lines_file('"",n\nx,1\ny,2\n'), lines_file("x,1\ny,2\n")
    a, b = infer.infer_table(spark, headed), infer.infer_table(spark, bare, options.RowGen(names=("label", "n")))
    assert a.names == ("", "n") and b.names == ("label", "n")
    assert [tuple(r) for r in readers.read_table(spark, headed, a).collect()] == [tuple(r) for r in readers.read_table(spark, bare, b).collect()]


def test_policies(spark, lines_file):
    path = lines_file("id,foo,name\n1,23,a\n2,,\n3,NA,NA\n4,bad,d\n5,6\n6,7,f,surplus\n\n")
    spec = infer.table_spec({"id": P.INT, "foo": P.INT, "name": P.TEXT})
    maybe = [tuple(r) for r in readers.read_table_maybe(spark, path, spec).collect()]
    assert maybe == [(1, 23, "a"), (2, None, ""), (3, None, "NA"), (4, None, "d"), (5, 6, None), (6, 7, "f"), (None, None, None)]
    assert [r.id for r in readers.read_table(spark, path, spec).collect()] == [1, 6]
    either = readers.read_table_either(spark, path, spec).collect()
    assert [r.foo.raw for r in either] == [None, "", "NA", "bad", None, None, ""]
    assert either[4].name.raw == "" and either[6].id.raw == ""
    good, bad = readers.read_table_debug(spark, path, spec)
    assert good.count() == 2 and bad.count() == 5 and good.columns == bad.columns == ["id", "foo", "name"]


def test_each_file_loses_its_header_only(spark, tmp_path):
    for n, body in enumerate(["x\nx\n1\n", "x\n", "x\n\n2\n", ""]):
        (tmp_path / f"f{n}.csv").write_text(body)
    spec = infer.table_spec({"x": P.TEXT})
    assert sorted(r.x for r in readers.read_table_maybe(spark, str(tmp_path), spec).collect()) == ["", "1", "2", "x"]


def test_header_with_many_splits(spark, tmp_path):
    (tmp_path / "f.csv").write_text("x\n" + "\n".join(map(str, range(20_000))) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = readers.read_table(spark, str(tmp_path), infer.table_spec({"x": P.INT}))
        assert df.rdd.getNumPartitions() > 4
        assert tuple(df.agg(F.count("x"), F.sum("x")).first()) == (20_000, sum(range(20_000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_latin1_and_crlf(spark, lines_file):
    path = lines_file("id,manager\r\n1,João\r\n2,Esperança\r\n", "latin-1")
    spec = infer.infer_table(spark, path, options.RowGen(encoding="ISO-8859-1"))
    assert [r.manager for r in readers.read_table(spark, path, spec).collect()] == ["João", "Esperança"]


def test_parse_guards(spark):
    df = to_frame(spark, [(x,) for x in ["5", "+5", "5.0", "5.00", "1,000", " 5", "1d", "inf", "NaN", "", "1e3", ".5", "0x1F", None]], "t string")
    got = df.select(P.INT.parse(F.col("t")).alias("i"), P.DOUBLE.parse(F.col("t")).alias("d"), P.BOOL.parse(F.col("t")).alias("b")).collect()
    assert [r.i for r in got] == [5, 5, 5] + [None] * 11
    assert [r.d for r in got] == [5.0, 5.0, 5.0, 5.0, 1000.0, None, None, None, None, None, 1000.0, None, None, None]
    assert all(r.b is None for r in got)


def test_overflow_is_missing(spark):
    df = to_frame(spark, [("9223372036854775808",), ("2147483648",)], "t string")
    got = df.select(P.INT.parse(F.col("t")).alias("a"), P.INT32.parse(F.col("t")).alias("b"), P.INTEGER.parse(F.col("t")).alias("c")).collect()
    assert [tuple(map(str, r)) for r in got] == [("None", "None", "9223372036854775808"), ("2147483648", "None", "2147483648")]


def test_categorical_codes(spark):
    levels = ["low", "mid", "high"]
    kind = P.categorical("Size", levels)
    df = to_frame(spark, [("mid",), ("none",), (None,), ("high",)], "t string").select(kind.parse(F.col("t")).alias("t"))
    got = df.select("t", P.level_code(F.col("t"), levels).alias("c")).collect()
    assert [tuple(r) for r in got] == [("mid", 1), (None, None), (None, None), ("high", 2)]
    assert P.code_type(128).simpleString() == "tinyint" and P.code_type(129).simpleString() == "smallint"


@pytest.mark.parametrize(
    ("name", "expected"),
    [("manager_id", "ManagerId"), ("", "Col"), ("1HrP", "Col1HrP"), ("type", "ColType"), ("class", "ColClass"), ("category name", "CategoryName"), ("age", "Age")],
)
def test_identifiers(name, expected):
    assert options.identifier(name) == expected
    assert options.identifier(name, "P") == "P" + expected


def test_accessors_and_manual_specs(spark):
    spec = infer.table_spec({"manager_id": P.INT, "class": P.TEXT}, prefix="emp").with_column("extra", P.DOUBLE)
    df = to_frame(spark, [(1, "a", 2.0)], spec)
    assert tuple(df.select(spec.columns.empManagerId, spec.columns.empColClass).first()) == (1, "a")
    assert spec.schema["manager_id"].metadata["identifier"] == "empManagerId"
    assert kinds(infer.TableSpec(("a",), (P.TEXT,), options.ParserOptions())) == ["Text"]


def test_text_table(spark, lines_file):
    assert kinds(infer.text_table(spark, lines_file(MANAGERS))) == ["Text"] * 4


def test_doubles_as_written(spark):
    cases = {0.1: "0.1", 0.05: "5.0e-2", 0.001234: "1.234e-3", 1234567.5: "1234567.5", 1e7: "1.0e7", 80000.0: "80000.0", 0.0: "0.0", -0.02: "-2.0e-2", 1.5e-10: "1.5e-10", -3.25: "-3.25"}
    df = to_frame(spark, [(x,) for x in cases], "x double")
    assert [r[0] for r in df.select(show_double(F.col("x"))).collect()] == list(cases.values())


def test_literals(spark):
    cases = {"Joe": '"Joe"', 'a"b\\': '"a\\"b\\\\"', "é1": '"\\233\\&1"', "é": '"\\233"', "a\tb\n": '"a\\tb\\n"', "": '""'}
    df = to_frame(spark, [(x,) for x in cases], "x string")
    assert [r[0] for r in df.select(show_literal(F.col("x"), df.schema["x"].dataType)).collect()] == list(cases.values())


def test_write_and_read_again(spark, lines_file, tmp_path):
    path = lines_file(MANAGERS)
    spec = infer.infer_table(spark, path)
    df = readers.read_table(spark, path, spec)
    assert [r.line for r in dsv.csv_lines(df).collect()] == ["id,manager,age,pay", "1,Joe,53,80000.0", "2,Sarah,44,80000.0"]
    for name, one in (("a", True), ("b", False)):
        dsv.write_csv(df, str(tmp_path / name), one_file=one)
        assert readers.read_table(spark, str(tmp_path / name), spec).orderBy("id").collect() == df.orderBy("id").collect()
    assert len([f for f in os.listdir(tmp_path / "a") if f.endswith(".txt")]) == 1


def test_quoted_output_reads_back(spark, tmp_path):
    df = to_frame(spark, [('a,"b"', 1), (" x ", 2), ("plain", 3), ('say "hi"', 4)], "t string, n bigint")
    dsv.write_dsv(df, str(tmp_path / "q"), quote_output=True)
    spec = infer.table_spec({"t": P.TEXT, "n": P.INT})
    assert sorted(map(tuple, readers.read_table(spark, str(tmp_path / "q"), spec).collect())) == sorted(map(tuple, df.collect()))


def test_show_frame(spark, capsys):
    df = to_frame(spark, [(1, "Joe", 53, 80000.0), (2, "Sarah", 44, 80000.0)], "id bigint, manager string, age bigint, pay double")
    assert dsv.show_frame(df) == 'id\tmanager\tage\tpay\n1\t"Joe"\t53\t80000.0\n2\t"Sarah"\t44\t80000.0\n'
    dsv.print_frame(df.where("id = 1"), ",")
    assert capsys.readouterr().out == 'id,manager,age,pay\n1,"Joe",53,80000.0\n'
    dsv.preview(df, lambda d: d.select("id"), 1)


def test_memory_sources(spark):
    assert [r.value for r in boxed_frame(spark, [3, 1], "bigint").collect()] == [3, 1]
    assert empty_frame(spark, "a int").count() == 0


def test_parse_line(spark):
    spec = infer.table_spec({"a": P.INT, "b": P.TEXT})
    row = spark.range(1).select(readers.parse_line(F.lit('x,"b, c"'), spec).alias("r")).first().r
    assert (row.a.value, row.a.raw, row.b.value, row.b.raw) == (None, "x", "b, c", None)


def test_quoting_modes_of_readers(spark, lines_file):
    path = lines_file('a,b\n"1",x\n2 ,y\n')
    columns = {"a": P.TEXT, "b": P.TEXT}
    raw = options.ParserOptions(quoting=options.NoQuoting())
    assert [r.a for r in readers.read_table(spark, path, infer.table_spec(columns, raw)).collect()] == ['"1"', "2 "]
    ignored = options.ParserOptions(quoting=options.NoQuoting(), ignore_quoting=True)
    assert [r.a for r in readers.read_table(spark, path, infer.table_spec(columns, ignored)).collect()] == ["1", "2"]


def folder_of(tmp_path, **files):
    for name, body in files.items():
        (tmp_path / f"{name}.txt").write_text(body)
    return str(tmp_path)


def test_infers_from_a_folder_whose_files_have_headers(spark, tmp_path):
    path = folder_of(tmp_path, a="id,x\n1,2\n", b="id,x\n2,3.5\n", c="", d="id,x\n3,\n")
    spec = infer.infer_table(spark, path)
    assert (spec.names, kinds(spec)) == (("id", "x"), ["Int", "Double"])
    assert kinds(infer.infer_table(spark, path, options.RowGen(lines=2))) == ["Int", "Int"]
    assert infer.text_table(spark, path).names == ("id", "x")
    bare = options.RowGen(names=("id", "x"))
    assert kinds(infer.infer_table(spark, path, bare)) == ["Text", "Text"]
    assert sorted(r.id for r in readers.read_table(spark, path, spec).collect()) == [1, 2]


def test_the_first_file_by_path_is_the_prefix(spark, tmp_path):
    """Spark reads the largest file first."""
    path = folder_of(tmp_path, **{"a b%20[1]": "k\n1\n2\n", "b": "k\n" + "x\n" * 500})
    assert kinds(infer.infer_table(spark, path, options.RowGen(lines=3))) == ["Int"]
    assert kinds(infer.infer_table(spark, path, options.RowGen(lines=4))) == ["Text"]


def test_own_output_is_inferred_again(spark, tmp_path):
    df = spark.range(100, numPartitions=7).select("id", (F.col("id") / 4).alias("x"))
    dsv.write_dsv(df, str(tmp_path / "o"))
    spec = infer.infer_table(spark, str(tmp_path / "o"))
    assert kinds(spec) == ["Int", "Double"] and readers.read_table(spark, str(tmp_path / "o"), spec).count() == 100


@pytest.mark.parametrize("split", ["128m", "20"])
def test_places_follow_paths_and_lines(spark, tmp_path, split):
    path = folder_of(tmp_path, a="x\n0\n1\n", b="x\n" + "".join(f"{n}\n" for n in range(2, 60)), c="x\n60\nbad\n61\n", d="", e="x\n62\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = readers.read_table(spark, path, infer.table_spec({"x": P.INT}), placed=True)
        assert got.columns == ["x", "_row_id"] and sorted(map(tuple, got.collect())) == [(n, n) for n in range(63)]
        maybe = readers.read_table_maybe(spark, path, infer.table_spec({"x": P.INT}), placed=True)
        assert maybe.where("x is null").first()["_row_id"] == 61 and maybe.count() == 64
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_types_that_are_unsure_or_refuse(spark, lines_file):
    year = P.ParseType("Year", P.INT.spark_type, lambda t: F.when(t.rlike("^[0-9]{4}$"), t.cast("bigint")), sure=lambda t: t.startswith("20"))
    kind = lambda cells, t=year: kinds(infer.infer_table(spark, lines_file("x\n" + "\n".join(cells) + "\n"), options.RowGen(universe=(t, *P.COMMON))))
    assert kind(["2001", "1999", "1850"]) == kind(["1999", "1850"]) == ["Year"]  # unsure cells do not count against it
    assert kind(["1999", "7"]) == kind(["7", "1999"]) == ["Int"] and kind(["1999", ""]) == ["Text"]
    few = P.ParseType("Few", P.TEXT.spark_type, lambda t: F.when(t.rlike("^[a-c]$"), t), combine=lambda seen: len(seen) < 3)
    assert kind(["a", "b", "a"], few) == ["Few"] and kind(["a", "b", "c"], few) == ["Text"]
