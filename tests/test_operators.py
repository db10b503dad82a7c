"""Columns, rows, missing cells, joins, melt, tagged values and folds on small tables."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import SchemaError
from tabspark.operators import columns as C
from tabspark.operators import folds, joins, materialise, missing, reshape, rows, tagged
from tabspark.sources.memory import empty_frame, to_frame


@pytest.fixture(scope="module")
def people(spark):
    return to_frame(spark, [(1, "Ann", 30, 1.5), (2, "Bob", None, 2.5), (3, None, 20, None), (2, "Bob", None, 2.5)], "id bigint, name string, age bigint, pay double")


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_project_and_order(people):
    assert C.project(people, "pay", "id").columns == ["pay", "id"]
    with pytest.raises(SchemaError):
        C.project(people, "nothing")


def test_update_keeps_place_and_type(people):
    df = C.modify(people, "age", lambda c: c * 2)
    assert df.columns == people.columns and {r.age for r in df.collect()} == {60, 40, None}
    with pytest.raises(SchemaError):
        C.put(people, "age", F.lit("text"))


def test_update_subset(people):
    df = C.update_subset(people, ["pay", "age"], lambda d: d.withColumns({"pay": F.col("pay") + F.col("age"), "age": F.col("age") + 1}))
    assert df.columns == people.columns and got(df)[0] == (1, "Ann", 31, 31.5)


def test_add_delete_move(people):
    assert C.prepend(people, "x", F.lit(1)).columns[0] == "x" and C.append(people, "x", F.lit(1)).columns[-1] == "x"
    with pytest.raises(SchemaError):
        C.append(people, "id", F.lit(1))
    assert C.delete(people, "name").columns == ["id", "age", "pay"]
    assert C.first_to_last(people).columns == ["name", "age", "pay", "id"]
    head, rest = C.first_and_rest(people)
    assert head.columns == ["id"] and rest.columns == ["name", "age", "pay"]


def test_maps_check_types(people):
    assert C.map_same(C.project(people, "id", "age"), lambda c: c > 1).dtypes == [("id", "boolean"), ("age", "boolean")]
    with pytest.raises(SchemaError):
        C.map_same(people, lambda c: c)
    assert C.map_numeric(C.project(people, "id", "pay"), lambda c: c + 1).dtypes == [("id", "bigint"), ("pay", "double")]
    with pytest.raises(SchemaError):
        C.map_numeric(people, lambda c: c)


def test_lists_and_shown(people):
    assert C.to_list(C.project(people, "id", "age")).first()["values"] == [1, 30]
    assert C.shown_fields(people).first().shown == ["1", '"Ann"', "30", "1.5"]
    assert C.headers(people) == people.columns
    with pytest.raises(SchemaError):
        C.field_at(people, 4)


def test_schema_functions(people):
    part = T.StructType([people.schema["age"]])
    assert C.schema_subset(part, people.schema) and not C.schema_subset(people.schema, part)
    assert C.schema_without(people.schema, ["id", "pay"]).names == ["name", "age"]
    assert {f.dataType for f in C.schema_replaced(people.schema, T.StringType())} == {T.StringType()}
    assert C.columns_of_type(people.schema, T.LongType) == ["id", "age"]


def test_names_with_points(spark):
    df = to_frame(spark, [(1, 2)], "`a.b` bigint, `c``d` bigint")
    assert C.project(df, "c`d", "a.b").first()[1] == 1
    assert C.modify(df, "a.b", lambda c: c + 1).first()[0] == 2


def test_filters_and_missing(people):
    assert rows.filter_rows(people, F.col("id") > 1, F.col("pay").isNotNull()).count() == 2
    assert missing.drop_incomplete(people).count() == 1 and missing.drop_incomplete(people, "name").count() == 3
    assert got(missing.fill(people, {"age": 0, "name": "?"}))[-1] == (3, "?", 20, None)
    assert missing.present(people, "age").count() == 2
    assert people.filter(missing.is_missing("age") & missing.contains_word("name", "BO")).count() == 2


def test_joins(spark):
    left = to_frame(spark, [("a", 1, 10), ("b", 2, 20), ("c", 2, 30), ("n", None, 0)], "l string, k bigint, m bigint")
    right = to_frame(spark, [("x", 2), ("y", 2), ("z", 3), ("n", None)], "r string, k bigint")
    inner = joins.inner_join(left, right, "k")
    assert inner.columns == ["l", "k", "m", "r"]
    pairs = [("b", 2, 20, "x"), ("b", 2, 20, "y"), ("c", 2, 30, "x"), ("c", 2, 30, "y")]
    assert got(inner) == pairs
    lefts, rights = [("a", 1, 10, None), ("n", None, 0, None)], [(None, 3, None, "z"), (None, None, None, "n")]
    assert got(joins.left_join(left, right, "k")) == sorted(pairs + lefts, key=repr)
    assert got(joins.right_join(left, right, "k")) == sorted(pairs + rights, key=repr)
    assert got(joins.outer_join(left, right, "k")) == sorted(pairs + lefts + rights, key=repr)


def test_joins_check_columns(spark):
    left, right = to_frame(spark, [(1, 2)], "k bigint, v bigint"), to_frame(spark, [(1, 2)], "k int, v bigint")
    with pytest.raises(SchemaError):
        joins.inner_join(left, right, "k")
    with pytest.raises(SchemaError):
        joins.inner_join(left, left, "k")
    with pytest.raises(SchemaError):
        joins.inner_join(left, right)
    assert joins.inner_join(left, empty_frame(spark, "k bigint, w string"), "k").count() == 0


def test_concat(spark, people):
    assert rows.concat(people, people, empty_frame(spark, people.schema)).count() == 8
    with pytest.raises(SchemaError):
        rows.concat(people, C.first_to_last(people))


@pytest.fixture(scope="module")
def numbered(spark):
    return spark.range(0, 20, numPartitions=6).select(F.col("id").alias("v"))


def test_places(spark, numbered):
    up, down = [F.col("v")], [F.col("v").desc()]
    read = numbered.withColumn(rows.ROW_ID, F.col("v") * 3)
    assert sorted((r.v, r.i) for r in rows.with_row_index(read, None, "i").collect()) == [(n, n) for n in range(20)]
    assert sorted((r.v, r.i) for r in rows.with_row_index(numbered, down, "i").collect()) == [(n, 19 - n) for n in range(20)]
    assert rows.with_row_index(read).columns == ["v", "_row_id"] and rows.with_row_index(read).agg(F.max("_row_id")).first()[0] == 19
    assert rows.with_row_index(numbered.limit(0), up).count() == 0
    assert rows.row_at(numbered, 3, down).first().v == 16 and rows.row_at(numbered, 30, up).count() == 0
    assert [r.v for r in rows.take_rows(numbered, 3, down).collect()] == [19, 18, 17] and rows.take_rows(numbered, -1, down).count() == 0
    assert rows.drop_rows(numbered, 18, down).count() == 2 and rows.drop_rows(numbered, 30, up).count() == 0
    assert rows.length(numbered) == 20
    for without_order in (lambda: rows.with_row_index(numbered), lambda: rows.row_at(numbered, 3), lambda: rows.zip_rows(numbered, read)):
        with pytest.raises(SchemaError):
            without_order()


def test_zip_is_as_long_as_the_shorter(spark, numbered):
    other, up = to_frame(spark, [("a",), ("b",), ("c",)], "t string"), [F.col("v")]
    assert got(rows.zip_rows(numbered, other, up, [F.col("t")])) == [(0, "a"), (1, "b"), (2, "c")]
    read = numbered.withColumn(rows.ROW_ID, -F.col("v"))
    assert rows.zip_rows(read, other, None, [F.col("t")]).columns == ["v", "t"]
    assert got(rows.zip_with(other, read, lambda b: F.concat("t", F.col("v").cast("string")), "x", [F.col("t")])) == [("a19",), ("b18",), ("c17",)]
    with pytest.raises(SchemaError):
        rows.zip_rows(numbered, numbered, up, up)


def test_chunks(numbered):
    order = [F.col("v")]
    assert got(rows.chunk_ids(numbered, 6, order).groupBy("chunk").count()) == [(0, 6), (1, 6), (2, 6), (3, 2)]
    assert sorted(r.v for r in rows.chunk_heads(numbered, 6, order).collect()) == [0, 6, 12, 18]
    assert got(rows.chunk_sizes(numbered, 10)) == [(0, 10), (1, 10)]
    assert got(rows.chunk_sizes(numbered, 10, True)) == [(0, 10), (1, 10), (2, 0)]
    assert got(rows.chunk_sizes(numbered, 6, True)) == [(0, 6), (1, 6), (2, 6), (3, 2)]
    assert got(rows.chunk_sizes(numbered.limit(0), 6)) == [] and got(rows.chunk_sizes(numbered.limit(0), 6, True)) == [(0, 0)]


def test_equality_and_flat_map(spark, people, numbered):
    order = [F.col("id"), F.col("age")]
    assert rows.equal_tables(people, people, order, order)
    assert not rows.equal_tables(people, people, order, [F.col("id").desc(), F.col("age")])
    assert not rows.equal_tables(numbered, numbered.where("v < 5"), [F.col("v")], [F.col("v")]) and not rows.equal_tables(people, numbered)
    spread = rows.flat_map(people, F.when(F.col("id") < 3, F.array(F.struct(F.lit(1).alias("x")), F.struct(F.lit(2).alias("x")))), "id")
    assert got(spread) == [(1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]


def test_arg_max(spark, people):
    best = rows.arg_max(people, F.col("pay"), F.col("id"))
    assert got(best) == [(2, "Bob", None, 2.5)] and rows.arg_max(people.limit(0), F.col("pay")).count() == 0
    assert rows.arg_max(people.where("id = 3"), F.col("pay")).count() == 1


def test_melt(spark, people):
    melted = reshape.melt(people, ["id"])
    assert melted.count() == people.count() * reshape.value_width(people, ["id"]) == 12
    assert melted.columns == ["id", "value"] and reshape.melt(people, ["id"], value_first=True).columns == ["value", "id"]
    assert melted.schema["value"].dataType.names == ["tag", "text", "int", "double"]
    first = melted.where("id = 1").collect()
    assert [(r.value.tag, r.value.text, r.value.int, r.value.double) for r in first] == [("name", "Ann", None, None), ("age", None, 30, None), ("pay", None, None, 1.5)]
    assert [x.value.tag for x in reshape.melt_rows(people, ["id"]).first().rows] == ["name", "age", "pay"]
    with pytest.raises(SchemaError):
        reshape.melt(people, ["other"])
    with pytest.raises(SchemaError):
        reshape.melt(people, people.columns)
    assert reshape.disjoint(["a"], ["b"]) and not reshape.disjoint(["a"], ["a"])


def test_tagged_values(spark, people):
    kinds = tagged.variants_of(people.schema, ["name", "age", "pay"])
    v = F.col("value")
    melted = reshape.melt(people.where("id = 1"), ["id"])
    assert [r[0] for r in melted.select(kinds.on_content(v, lambda c: c.cast("string"))).collect()] == ["Ann", "30", "1.5"]
    assert [r[0] for r in melted.select(kinds.as_tag(v, "age")).collect()] == [None, 30, None]
    assert [r[0] for r in melted.select(kinds.as_type(v, "text")).collect()] == ["Ann", None, None]
    assert [r[0] for r in melted.select(kinds.show(v)).collect()] == ['name :-> "Ann"', "age :-> 30", "pay :-> 1.5"]
    assert tuple(melted.select(kinds.to_row(v).alias("r")).select("r.*").collect()[1]) == (None, 30, None)
    assert [r[0].double for r in melted.select(kinds.map(v, {"double": lambda c: c * 2})).collect()] == [None, None, 3.0]
    assert melted.where(kinds.equal(v, kinds.make("age", F.lit(30)))).count() == 1
    with pytest.raises(SchemaError):
        kinds.match(v, {"name": lambda c: c})
    with pytest.raises(SchemaError):
        kinds.as_tag(v, "other")


def test_first_and_last_field(people):
    names = ["age", "pay", "name"]
    got_first = [r[0] and r[0].tag for r in people.select(tagged.first_field(people.schema, names)).collect()]
    got_last = [r[0] and r[0].tag for r in people.select(tagged.last_field(people.schema, names)).collect()]
    assert got_first == ["age", "pay", "age", "pay"] and got_last == ["name", "name", "age", "name"]
    nothing = people.select(F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("string").alias("b"))
    assert nothing.select(tagged.first_field(nothing.schema, ["a", "b"])).first()[0] is None


def test_folds(spark, people):
    r = folds.run(
        people,
        total=folds.total(F.col("pay")), n=folds.count(), mean=folds.mean(F.col("pay")), low=folds.minimum(F.col("age")), high=folds.maximum(F.col("age")),
        bobs=folds.count().where(F.col("name") == "Bob"), both=folds.count().join(folds.total(F.col("id")), lambda a, b: a + b), twice=folds.count().map(lambda c: c * 2),
        most=folds.maximum(F.col("id")).where(F.col("pay").isNotNull()).where(F.col("age").isNotNull()),
    ).first()
    assert (r.total, r.n, r.low, r.high, r.bobs, r.both, r.twice, r.most) == (6.5, 4, 20, 30, 2, 12, 8, 1)
    assert r.mean == pytest.approx(6.5 / 3)
    none = folds.run(people.limit(0), total=folds.total(F.col("pay")), n=folds.count(), mean=folds.mean(F.col("pay")), low=folds.minimum(F.col("age"))).first()
    assert (none.total, none.n, none.low) == (0, 0, None) and math.isnan(none.mean)


def test_custom_fold(numbered):
    step = lambda s, b: s + sum(b.column(0).to_pylist())
    assert folds.fold_batches(numbered, lambda: 0, step, lambda a, b: a + b) == 190
    assert folds.fold_batches(numbered.limit(0), lambda: 0, step, lambda a, b: a + b) == 0


def test_keeping_in_memory(people):
    kept = materialise.in_memory(people, "id")
    assert kept.columns == ["id"] and kept.storageLevel.useMemory
    n, table = materialise.with_length(people)
    assert n == 4 and table.count() == 4
    again = materialise.replay(people)
    assert len(list(again())) == len(list(again())) == 4
    assert materialise.in_memory_after(people, lambda d: d.select("age")).columns == ["age"]
    assert materialise.force(people) is people
    for df in (kept, table):
        df.unpersist()


def test_only_needed_columns_are_read(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as b", "id * 3 as c").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = rows.filter_rows(C.project(df, "id", "b"), F.col("b") > 50)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,b:bigint>" in plan and "GreaterThan(b,50)" in plan


def test_records_side_by_side_and_cell_maps(spark):
    df = to_frame(spark, [((1, None), ("x", 2.0), (5, 6))], "a struct<p:int,q:int>, b struct<r:string,s:double>, c struct<p:int,q:int>")
    assert C.append_records(df, "b", "a").columns == ["r", "s", "p", "q"] and tuple(C.append_records(df, "b", "a").first()) == ("x", 2.0, 1, None)
    with pytest.raises(SchemaError):
        C.append_records(df, "a", "c")
    assert tuple(missing.zip_cells(df, "a", "c", F.coalesce).first()) == (1, 6)
    with pytest.raises(SchemaError):
        missing.zip_cells(df, "a", "b", F.coalesce)
    flat = to_frame(spark, [(1, None, "k")], "p int, q int, t string")
    assert tuple(missing.map_cells(flat, lambda c: c.cast("string"), F.lit("?")).first()) == ("1", "?", "k")
    shown = flat.select(C.shown_field(flat, "t"), C.shown_field(flat, "p", True), C.shown_field(flat, "q", True)).first()
    assert tuple(shown) == ('t :-> "k"', "(p :-> 1)", None)
