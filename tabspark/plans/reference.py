"""Queries that show each operator of the table library over whole driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.functions import parsing as P
from tabspark.operators import columns as C
from tabspark.operators import folds, joins, missing, reshape, rows, tagged
from tabspark.session import temporary_folder
from tabspark.sinks import dsv
from tabspark.sources import infer, options, readers, text
from tabspark.sources.memory import empty_frame, to_frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _orders_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """orders, with prices and priorities missing here and there."""
    df = C.project(table(spark, folder, "orders"), "o_orderkey", "o_totalprice", "o_orderpriority")
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    return C.update(df, {"o_totalprice": price, "o_orderpriority": F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))})


GAPS = """(select o_orderkey, case when o_orderkey % 7 <> 0 then o_totalprice end as o_totalprice,
  case when o_orderkey % 5 <> 0 then o_orderpriority end as o_orderpriority from orders)"""


def written(df: DataFrame, opts: options.ParserOptions = options.ParserOptions(), quote_output: bool = False) -> str:
    path = temporary_folder("dsv") + "/files"
    dsv.write_dsv(df, path, opts, quote_output)
    return path


# --- projection and columns


@query("select round(avg(l_extendedprice * (1 - l_discount) / l_extendedprice), 6) as mean_ratio, count(*) as n from lineitem where l_quantity > 10")
def mean_ratio(spark: SparkSession, folder: str) -> DataFrame:
    lines = rows.filter_rows(table(spark, folder, "lineitem"), F.col("l_quantity") > 10)
    priced = C.project(lines, "l_extendedprice", "l_discount")
    ratio = F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_extendedprice")
    return folds.run(priced, mean_ratio=folds.mean(ratio).map(lambda c: F.round(c, 6)), n=folds.count())


@query("select round(avg(l_extendedprice), 4) as mean_price, round(avg(l_quantity), 4) as mean_quantity from lineitem")
def two_column_mean(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    rounded = lambda c: F.round(c, 4)
    return folds.run(lines, mean_price=folds.mean(F.col("l_extendedprice")).map(rounded), mean_quantity=folds.mean(F.col("l_quantity")).map(rounded))


@query("select l_shipdate, l_orderkey, l_quantity from lineitem")
def project_columns(spark: SparkSession, folder: str) -> DataFrame:
    return C.project(table(spark, folder, "lineitem"), "l_shipdate", "l_orderkey", "l_quantity")


@query("select c_custkey, upper(c_name) as c_name, c_nationkey, c_acctbal * 2 as c_acctbal, c_mktsegment from customer")
def update_columns(spark: SparkSession, folder: str) -> DataFrame:
    df = C.modify(table(spark, folder, "customer"), "c_acctbal", lambda c: c * 2)
    return C.put(df, "c_name", F.upper("c_name"))


@query("select p_partkey, lower(p_name) as p_name, p_brand, p_type, p_size + 1 as p_size, p_retailprice from part")
def update_subset(spark: SparkSession, folder: str) -> DataFrame:
    change = lambda part: part.withColumns({"p_name": F.lower("p_name"), "p_size": (F.col("p_size") + 1).cast("int")})
    return C.update_subset(table(spark, folder, "part"), ["p_name", "p_size"], change)


@query("select s_acctbal * 100 as cents, s_suppkey, s_name, s_nationkey, s_acctbal, s_name || '!' as called from supplier")
def add_columns(spark: SparkSession, folder: str) -> DataFrame:
    df = C.prepend(table(spark, folder, "supplier"), "cents", F.col("s_acctbal") * 100)
    return C.append(df, "called", F.concat("s_name", F.lit("!")))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate from orders")
def delete_column(spark: SparkSession, folder: str) -> DataFrame:
    return C.delete(table(spark, folder, "orders"), "o_orderpriority")


@query("select n_name, n_regionkey, n_nationkey from nation")
def first_to_last(spark: SparkSession, folder: str) -> DataFrame:
    return C.first_to_last(table(spark, folder, "nation"))


@query("select n_name, n_regionkey from nation")
def without_first(spark: SparkSession, folder: str) -> DataFrame:
    return C.first_and_rest(table(spark, folder, "nation"))[1]


@query("select l_quantity + 0.5 as l_quantity, l_discount + 0.5 as l_discount, l_tax + 0.5 as l_tax from lineitem")
def map_same_type(spark: SparkSession, folder: str) -> DataFrame:
    return C.map_same(C.project(table(spark, folder, "lineitem"), "l_quantity", "l_discount", "l_tax"), lambda c: c + 0.5)


@query("select p_partkey * 2 as p_partkey, p_size * 2 as p_size, p_retailprice * 2 as p_retailprice from part")
def map_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return C.map_numeric(C.project(table(spark, folder, "part"), "p_partkey", "p_size", "p_retailprice"), lambda c: c * 2)


@query('select unnest([l_orderkey, l_partkey, l_suppkey]) as "values" from lineitem')
def row_lists(spark: SparkSession, folder: str) -> DataFrame:
    lists = C.to_list(C.project(table(spark, folder, "lineitem"), "l_orderkey", "l_partkey", "l_suppkey"))
    return lists.select(F.explode("values").alias("values"))


@query("select l_extendedprice / l_quantity as unit_price from lineitem")
def apply_row(spark: SparkSession, folder: str) -> DataFrame:
    return C.apply_row(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"], lambda price, n: price / n, "unit_price")


@query("""select cast(n_nationkey as varchar) || '|"' || n_name || '"' as shown from nation""")
def shown_fields(spark: SparkSession, folder: str) -> DataFrame:
    shown = C.shown_fields(C.project(table(spark, folder, "nation"), "n_nationkey", "n_name"))
    return shown.select(F.concat_ws("|", "shown").alias("shown"))


@query("select n_regionkey as third from nation")
def column_by_place(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "nation")
    return df.select(C.field_at(df, 2).alias("third"))


# --- filters and missing data


@query("select * from lineitem where l_discount > 0.05")
def filter_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rows.filter_rows(table(spark, folder, "lineitem"), F.col("l_discount") > 0.05)


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_quantity < 5")
def filter_chain(spark: SparkSession, folder: str) -> DataFrame:
    return C.project(rows.filter_rows(table(spark, folder, "lineitem"), F.col("l_returnflag") == "R", F.col("l_quantity") < 5), "l_orderkey", "l_linenumber")


@query("select p_partkey, p_type from part where contains(lower(p_type), 'promo')")
def filter_word(spark: SparkSession, folder: str) -> DataFrame:
    return C.project(table(spark, folder, "part").filter(missing.contains_word("p_type", "Promo")), "p_partkey", "p_type")


@query(f"select * from {GAPS} where o_totalprice is not null and o_orderpriority is not null")
def drop_missing(spark: SparkSession, folder: str) -> DataFrame:
    return missing.drop_incomplete(_orders_with_gaps(spark, folder))


@query(f"select o_orderkey, coalesce(o_totalprice, -1) as o_totalprice, coalesce(o_orderpriority, 'none') as o_orderpriority from {GAPS}")
def fill_missing(spark: SparkSession, folder: str) -> DataFrame:
    return missing.fill(_orders_with_gaps(spark, folder), {"o_totalprice": -1, "o_orderpriority": "none"})


@query(f"select count(o_totalprice) as n, round(avg(o_totalprice), 4) as mean from {GAPS} where o_orderpriority is null")
def missing_count_mean(spark: SparkSession, folder: str) -> DataFrame:
    unknown = _orders_with_gaps(spark, folder).filter(missing.is_missing("o_orderpriority"))
    return folds.run(missing.present(unknown, "o_totalprice"), n=folds.count(), mean=folds.mean(F.col("o_totalprice")).map(lambda c: F.round(c, 4)))


# --- joins


def _orders_and_customers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Whole tables; some customers have no order."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return orders, C.project(table(spark, folder, "customer"), "c_name", "c_custkey")


_CUSTOMERS = "(select c_name, c_custkey from customer)"
_BOUGHT = "(select o_orderkey, o_custkey as c_custkey, o_totalprice from orders)"


@query(f"select o_orderkey, c_custkey, o_totalprice, c_name from {_BOUGHT} join {_CUSTOMERS} using (c_custkey)")
def inner_join(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = _orders_and_customers(spark, folder)
    return joins.inner_join(orders, customers, "c_custkey")


@query(f"select c_name, c_custkey, o_orderkey, o_totalprice from {_CUSTOMERS} left join {_BOUGHT} using (c_custkey)")
def left_join(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = _orders_and_customers(spark, folder)
    return joins.left_join(customers, orders, "c_custkey")


@query(f"select o_orderkey, c_custkey, o_totalprice, c_name from {_BOUGHT} right join {_CUSTOMERS} using (c_custkey)")
def right_join(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = _orders_and_customers(spark, folder)
    return joins.right_join(orders, customers, "c_custkey")


@query(f"select o_orderkey, c_custkey, o_totalprice, c_name from {_BOUGHT} full join {_CUSTOMERS} using (c_custkey)")
def outer_join(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = _orders_and_customers(spark, folder)
    return joins.outer_join(orders, customers, "c_custkey")


@query("select l_orderkey, l_quantity, o_custkey, o_totalprice from lineitem join orders on l_orderkey = o_orderkey")
def inner_join_large(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice")
    return joins.inner_join(C.project(table(spark, folder, "lineitem"), "l_orderkey", "l_quantity"), orders, "l_orderkey")


@query("""select l_partkey, l_suppkey, a.l_orderkey, a.l_linenumber, b.other_orderkey, b.other_quantity from lineitem a
  join (select l_partkey, l_suppkey, l_orderkey as other_orderkey, l_quantity as other_quantity from lineitem) b using (l_partkey, l_suppkey)""")
def inner_join_multikey(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    others = lines.select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("other_orderkey"), F.col("l_quantity").alias("other_quantity"))
    return joins.inner_join(C.project(lines, "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"), others, "l_partkey", "l_suppkey")


# Whole tables; some orders have no line.
def _orders_and_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice")
    return orders, C.project(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


_ORDERS = "(select o_orderkey as l_orderkey, o_custkey, o_totalprice from orders)"
_LINES = "(select l_orderkey, l_linenumber, l_quantity from lineitem)"


@query(f"select l_orderkey, o_custkey, o_totalprice, l_linenumber, l_quantity from {_ORDERS} left join {_LINES} using (l_orderkey)")
def left_join_large(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = _orders_and_lines(spark, folder)
    return joins.left_join(orders, lines, "l_orderkey")


@query(f"select l_orderkey, l_linenumber, l_quantity, o_custkey, o_totalprice from {_LINES} right join {_ORDERS} using (l_orderkey)")
def right_join_large(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = _orders_and_lines(spark, folder)
    return joins.right_join(lines, orders, "l_orderkey")


@query(f"select l_orderkey, l_linenumber, l_quantity, o_custkey, o_totalprice from {_LINES} full join {_ORDERS} using (l_orderkey)")
def outer_join_large(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = _orders_and_lines(spark, folder)
    return joins.outer_join(lines, orders, "l_orderkey")


# --- sets of rows and places


@query("select c_custkey, c_acctbal from customer where c_acctbal < 0 union all select c_custkey, c_acctbal from customer where c_acctbal < 1000")
def concat_tables(spark: SparkSession, folder: str) -> DataFrame:
    df = C.project(table(spark, folder, "customer"), "c_custkey", "c_acctbal")
    return rows.concat(df.filter("c_acctbal < 0"), df.filter("c_acctbal < 1000"))


@query("select r_regionkey, r_name from region")
def concat_empty(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "region")
    return rows.concat(empty_frame(spark, df.schema), df)


@query("""select s_suppkey, s_name, n_name from (select *, row_number() over (order by s_suppkey) i from supplier)
  join (select n_name, row_number() over (order by n_nationkey) i from nation) using (i)""")
def zip_tables(spark: SparkSession, folder: str) -> DataFrame:
    left = C.project(table(spark, folder, "supplier"), "s_suppkey", "s_name")
    nations = table(spark, folder, "nation")
    zipped = rows.zip_rows(left, C.project(nations, "n_nationkey", "n_name"), [F.col("s_suppkey")], [F.col("n_nationkey")])
    return C.delete(zipped, "n_nationkey")


@query("""select s_name || '/' || n_name as pair from (select *, row_number() over (order by s_suppkey) i from supplier)
  join (select n_name, row_number() over (order by n_nationkey) i from nation) using (i)""")
def zip_with(spark: SparkSession, folder: str) -> DataFrame:
    left, right = table(spark, folder, "supplier"), table(spark, folder, "nation")
    return rows.zip_with(left, right, lambda both: F.concat("s_name", F.lit("/"), "n_name"), "pair", [F.col("s_suppkey")], [F.col("n_nationkey")])


@query("select o_orderkey, o_totalprice, cast(row_number() over (order by o_totalprice, o_orderkey) - 1 as bigint) as place from orders")
def row_index(spark: SparkSession, folder: str) -> DataFrame:
    return rows.with_row_index(C.project(table(spark, folder, "orders"), "o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], "place")


@query("select o_orderkey, o_orderdate from orders order by o_orderkey limit 1 offset 99")
def row_at(spark: SparkSession, folder: str) -> DataFrame:
    return rows.row_at(C.project(table(spark, folder, "orders"), "o_orderkey", "o_orderdate"), 99, [F.col("o_orderkey")])


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 100")
def take_rows(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return rows.take_rows(C.project(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice"), 100, order)


@query("select o_orderkey, o_custkey from orders order by o_orderkey offset 200")
def drop_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rows.drop_rows(C.project(table(spark, folder, "orders"), "o_orderkey", "o_custkey"), 200, [F.col("o_orderkey")])


@query("select o_orderkey, cast((row_number() over (order by o_orderkey) - 1) // 64 as bigint) as chunk from orders")
def frame_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return rows.chunk_ids(C.project(table(spark, folder, "orders"), "o_orderkey"), 64, [F.col("o_orderkey")])


@query("select cast((i - 1) // 64 as bigint) as chunk, o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) i from orders) where (i - 1) % 64 = 0")
def chunk_heads(spark: SparkSession, folder: str) -> DataFrame:
    return rows.chunk_heads(C.project(table(spark, folder, "orders"), "o_orderkey"), 64, [F.col("o_orderkey")])


@query("""select cast(c as bigint) as chunk, cast(least(100, n - c * 100) as bigint) as n from (select count(*) n from orders),
  lateral (select unnest(range(cast(n // 100 + 1 as bigint))) c)""")
def chunk_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return rows.chunk_sizes(table(spark, folder, "orders"), 100, trailing_empty=True)


@query("select c_custkey, unnest(range(1, c_nationkey + 1)) as step from customer")
def flat_map(spark: SparkSession, folder: str) -> DataFrame:
    steps = F.when(F.col("c_nationkey") > 0, F.sequence(F.lit(1), F.col("c_nationkey")))
    return rows.flat_map(table(spark, folder, "customer"), F.transform(steps, lambda i: F.struct(i.cast("bigint").alias("step"))), "c_custkey")


@query("select c_custkey, length(c_name) * 2 as doubled from customer")
def map_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rows.map_rows(table(spark, folder, "customer"), c_custkey=F.col("c_custkey"), doubled=(F.length("c_name") * 2).cast("bigint"))


@query("select r_regionkey, r_name, 7 as seven from region")
def constant_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rows.constant(table(spark, folder, "region"), F.lit(7), "seven")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 1")
def arg_max(spark: SparkSession, folder: str) -> DataFrame:
    return rows.arg_max(C.project(table(spark, folder, "orders"), "o_orderkey", "o_totalprice"), F.col("o_totalprice"), F.col("o_orderkey"))


@query("select true as same, false as reversed_same")
def tables_equal(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "supplier")
    up, down = [F.col("s_suppkey")], [F.col("s_suppkey").desc()]
    return to_frame(spark, [(rows.equal_tables(df, df, up, up), rows.equal_tables(df, df, up, down))], "same boolean, reversed_same boolean")


# --- melt and tagged values


@query("""select l_orderkey, l_linenumber, 'l_quantity' as tag, l_quantity as double from lineitem
  union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem""")
def melt_same_type(spark: SparkSession, folder: str) -> DataFrame:
    df = C.project(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return reshape.melt(df, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "value.*")


@query("""select c_custkey, 'c_name' as tag, c_name as text, null::int as int_slot, null::double as double_slot from customer
  union all select c_custkey, 'c_nationkey', null, c_nationkey, null from customer
  union all select c_custkey, 'c_acctbal', null, null, c_acctbal from customer""")
def melt_tagged(spark: SparkSession, folder: str) -> DataFrame:
    df = C.project(table(spark, folder, "customer"), "c_custkey", "c_name", "c_nationkey", "c_acctbal")
    melted = reshape.melt(df, ["c_custkey"])
    return melted.select("c_custkey", "value.tag", "value.text", F.col("value.int").alias("int_slot"), F.col("value.double").alias("double_slot"))


@query("""select c_custkey, 'name ' || c_name as said from customer union all select c_custkey, 'nation ' || c_nationkey from customer""")
def match_variants(spark: SparkSession, folder: str) -> DataFrame:
    df = C.project(table(spark, folder, "customer"), "c_custkey", "c_name", "c_nationkey")
    kinds = tagged.variants_of(df.schema, ["c_name", "c_nationkey"])
    handlers = {"c_name": lambda c: F.concat(F.lit("name "), c), "c_nationkey": lambda c: F.concat(F.lit("nation "), c.cast("string"))}
    return reshape.melt(df, ["c_custkey"]).select("c_custkey", kinds.match(F.col("value"), handlers).alias("said"))


@query("""select c_custkey, cast(c_name as varchar) as said from customer union all select c_custkey, cast(c_nationkey as varchar) from customer""")
def on_any_variant(spark: SparkSession, folder: str) -> DataFrame:
    df = C.project(table(spark, folder, "customer"), "c_custkey", "c_name", "c_nationkey")
    kinds = tagged.variants_of(df.schema, ["c_name", "c_nationkey"])
    return reshape.melt(df, ["c_custkey"]).select("c_custkey", kinds.on_content(F.col("value"), lambda c: c.cast("string")).alias("said"))


@query("""select c_custkey, c_name, null::int as c_nationkey from customer union all select c_custkey, null, c_nationkey from customer""")
def variant_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = C.project(table(spark, folder, "customer"), "c_custkey", "c_name", "c_nationkey")
    kinds = tagged.variants_of(df.schema, ["c_name", "c_nationkey"])
    return reshape.melt(df, ["c_custkey"]).select("c_custkey", kinds.to_row(F.col("value")).alias("r")).select("c_custkey", "r.*")


@query(f"""select o_orderkey, case when o_totalprice is not null then 'o_totalprice' when o_orderpriority is not null then 'o_orderpriority' end as first_tag,
  case when o_orderpriority is not null then 'o_orderpriority' when o_totalprice is not null then 'o_totalprice' end as last_tag,
  case when o_totalprice is null then o_orderpriority end as first_text, case when o_orderpriority is null then o_totalprice end as last_double from {GAPS}""")
def first_last_field(spark: SparkSession, folder: str) -> DataFrame:
    df = _orders_with_gaps(spark, folder)
    names = ["o_totalprice", "o_orderpriority"]
    both = df.select("o_orderkey", tagged.first_field(df.schema, names).alias("f"), tagged.last_field(df.schema, names).alias("l"))
    return both.select("o_orderkey", F.col("f.tag").alias("first_tag"), F.col("l.tag").alias("last_tag"), F.col("f.text").alias("first_text"), F.col("l.double").alias("last_double"))


@query("select l_orderkey, l_linenumber, l_quantity + l_discount + l_tax as total, greatest(l_quantity, l_discount, l_tax) as largest from lineitem")
def fold_fields(spark: SparkSession, folder: str) -> DataFrame:
    names = ["l_quantity", "l_discount", "l_tax"]
    total = tagged.fold_fields(names, F.lit(0.0), lambda a, b: a + b)
    largest = tagged.fold_fields1(names, lambda a, b: F.greatest(a, b))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", total.alias("total"), largest.alias("largest"))


# --- folds


@query("select round(sum(l_quantity), 2) as total, count(*) as n, round(sum(l_quantity) / count(*), 6) as mean from lineitem")
def fold_sum_count_mean(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("l_quantity")
    mean = folds.total(q).join(folds.count(), lambda s, n: F.round(s / n, 6))
    return folds.run(table(spark, folder, "lineitem"), total=folds.total(q).map(lambda c: F.round(c, 2)), n=folds.count(), mean=mean)


@query("select min(l_shipdate) as first_ship, max(l_extendedprice) as top_price, max(l_extendedprice * l_discount) as top_saving from lineitem")
def fold_min_max(spark: SparkSession, folder: str) -> DataFrame:
    saving = F.col("l_extendedprice") * F.col("l_discount")
    return folds.run(table(spark, folder, "lineitem"), first_ship=folds.minimum(F.col("l_shipdate")), top_price=folds.maximum(F.col("l_extendedprice")), top_saving=folds.maximum(saving))


@query("select count(*) filter (l_returnflag = 'R') as returned, round(avg(l_quantity) filter (l_returnflag = 'R'), 6) as mean_returned from lineitem")
def fold_where(spark: SparkSession, folder: str) -> DataFrame:
    back = F.col("l_returnflag") == "R"
    return folds.run(table(spark, folder, "lineitem"), returned=folds.count().where(back), mean_returned=folds.mean(F.col("l_quantity")).where(back).map(lambda c: F.round(c, 6)))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as total, max(l_discount) as top_discount from lineitem group by all")
def fold_groups(spark: SparkSession, folder: str) -> DataFrame:
    total = folds.total(F.col("l_quantity")).map(lambda c: F.round(c, 2))
    return folds.run_by(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], n=folds.count(), total=total, top_discount=folds.maximum(F.col("l_discount")))


@query("select max(length(c_name)) as longest, count(*) as n from customer")
def fold_custom(spark: SparkSession, folder: str) -> DataFrame:
    def step(state, batch):  # noqa: ANN001, ANN202
        lengths = [len(x) for x in batch.column(0).to_pylist() if x is not None]
        return max([state[0], *lengths]), state[1] + batch.num_rows

    found = folds.fold_batches(C.project(table(spark, folder, "customer"), "c_name"), lambda: (0, 0), step, lambda a, b: (max(a[0], b[0]), a[1] + b[1]))
    return to_frame(spark, [found], "longest bigint, n bigint")


# --- categoricals, text sources and sinks


@query("""select c_custkey, list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 as code, c_mktsegment as level from customer
  where c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')""")
def categorical_codes(spark: SparkSession, folder: str) -> DataFrame:
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    kind = P.categorical("Segment", levels)
    code = P.level_code(kind.parse(F.col("c_mktsegment")), levels)
    coded = table(spark, folder, "customer").select("c_custkey", code.cast("int").alias("code"), P.level_of(code, levels).alias("level"))
    return missing.drop_incomplete(coded, "code")


NATION = {"n_nationkey": P.INT32, "n_name": P.TEXT, "n_regionkey": P.INT32}


@query("select * from nation")
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return readers.read_table(spark, written(table(spark, folder, "nation")), infer.table_spec(NATION))


@query("select * from nation")
def dsv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    opts = options.ParserOptions(separator="||")
    return readers.read_table(spark, written(table(spark, folder, "nation"), opts), infer.table_spec(NATION, opts))


@query("select event_id, user_id, event_type, value, props from events")
def quoted_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    df = C.project(table(spark, folder, "events"), "event_id", "user_id", "event_type", "value", "props")
    spec = infer.table_spec({"event_id": P.INT, "user_id": P.INT, "event_type": P.TEXT, "value": P.DOUBLE, "props": P.TEXT})
    return readers.read_table(spark, written(df, quote_output=True), spec)


@query("select 'c_custkey' as name, 'Int' as kind union all select 'c_name', 'Text' union all select 'c_acctbal', 'Double' union all select 'c_mktsegment', 'Categorical'")
def infer_types(spark: SparkSession, folder: str) -> DataFrame:
    path = written(C.project(table(spark, folder, "customer"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    spec = infer.infer_table(spark, path, options.categorical_row_gen())
    names = [(n, "Categorical" if "levels" in t.metadata else t.name) for n, t in zip(spec.names, spec.types, strict=True)]
    return to_frame(spark, names, "name string, kind string")


@query("select c_custkey, c_name, c_acctbal from customer")
def infer_and_read(spark: SparkSession, folder: str) -> DataFrame:
    path = written(C.project(table(spark, folder, "customer"), "c_custkey", "c_name", "c_acctbal"))
    return readers.read_table(spark, path, infer.infer_table(spark, path))


def _dirty_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines of which some have a bad number, a missing one, too few or too many cells."""
    key = F.col("o_orderkey")
    price = F.when(key % 11 == 0, "n/k").when(key % 13 == 0, "NA").when(key % 17 == 0, "").otherwise(key.cast("string"))
    parts = [key.cast("string"), price, F.col("o_orderstatus")]
    line = F.when(key % 19 == 0, F.concat_ws(",", *parts[:2])).when(key % 23 == 0, F.concat_ws(",", *parts, F.lit("more"))).otherwise(F.concat_ws(" , ", *parts))
    return table(spark, folder, "orders").select(line.alias("value"))


ORDER_SPEC = infer.table_spec({"key": P.INT, "price": P.DOUBLE, "status": P.TEXT})
_DIRTY = """(select o_orderkey as key, case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 or o_orderkey % 17 = 0 then null else cast(o_orderkey as double) end as price,
  case when o_orderkey % 19 = 0 then null else o_orderstatus end as status,
  case when o_orderkey % 11 = 0 then 'n/k' when o_orderkey % 13 = 0 then 'NA' when o_orderkey % 17 = 0 then '' end as raw from orders)"""


@query(f"select key, price, status from {_DIRTY}")
def parse_maybe(spark: SparkSession, folder: str) -> DataFrame:
    return readers.parse_maybe(text.tokenize(_dirty_lines(spark, folder), ORDER_SPEC.options), ORDER_SPEC)


@query(f"select key, price, status from {_DIRTY} where price is not null and status is not null")
def parse_strict(spark: SparkSession, folder: str) -> DataFrame:
    return readers.parse_strict(text.tokenize(_dirty_lines(spark, folder), ORDER_SPEC.options), ORDER_SPEC)


@query(f"select key, price, raw as price_raw, status, case when status is null then '' end as status_raw from {_DIRTY}")
def parse_either(spark: SparkSession, folder: str) -> DataFrame:
    either = readers.parse_either(text.tokenize(_dirty_lines(spark, folder), ORDER_SPEC.options), ORDER_SPEC)
    return either.select("key.value", "price.value", "price.raw", "status.value", "status.raw").toDF("key", "price", "price_raw", "status", "status_raw")


@query(f"select (price is not null and status is not null) as ok, count(*) as n from {_DIRTY} group by 1")
def parse_checked(spark: SparkSession, folder: str) -> DataFrame:
    checked = readers.parse_checked(text.tokenize(_dirty_lines(spark, folder), ORDER_SPEC.options), ORDER_SPEC)
    return checked.groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id, event_type as second, props as third from events""")
def tokenize_lines(spark: SparkSession, folder: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = table(spark, folder, "events").select(F.concat_ws(",", F.col("event_id").cast("string"), F.concat(F.lit("  "), "event_type", F.lit(" ")), quoted).alias("value"))
    got = text.tokenize(lines, options.ParserOptions())
    return got.select(F.get("tokens", F.lit(0)).cast("bigint").alias("event_id"), F.get("tokens", F.lit(1)).alias("second"), F.get("tokens", F.lit(2)).alias("third"))


@query("""select 'o_orderkey,o_orderstatus,late' as line union all select o_orderkey || ',' || o_orderstatus || ',' || case when o_totalprice > 1000 then 'True' else 'False' end from orders""")
def csv_lines(spark: SparkSession, folder: str) -> DataFrame:
    return dsv.csv_lines(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") > 1000).alias("late")))


@query("""select 'n_nationkey' || chr(9) || 'n_name' as line union all select n_nationkey || chr(9) || '"' || n_name || '"' from nation""")
def shown_table(spark: SparkSession, folder: str) -> DataFrame:
    lines = dsv.shown_lines(C.project(table(spark, folder, "nation"), "n_nationkey", "n_name"))
    return to_frame(spark, [(line,) for line in lines], "line string")


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events where value is not null group by event_type")
def streamed_events(spark: SparkSession, folder: str) -> DataFrame:
    from tabspark.streaming.tables import stream_chunks

    source = spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/events.parquet*")
    work = temporary_folder("stream")

    def add(batch: DataFrame, number: int) -> None:
        partial = batch.where("value is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        partial.write.mode("overwrite").parquet(f"{work}/out/batch={number}")

    stream_chunks(source, f"{work}/state", add).awaitTermination()
    parts = spark.read.schema("event_type string, n bigint, total double, batch bigint").parquet(f"{work}/out")
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
