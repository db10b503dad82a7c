"""Further queries over whole driver tables: text folders, encodings, typed cells, names, in-memory forms and streams."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.functions import parsing as P
from tabspark.operators import columns as C
from tabspark.operators import folds, materialise, missing, reshape, rows, tagged
from tabspark.plans.reference import GAPS, ORACLES, ORDER_SPEC, QUERIES, _DIRTY, _dirty_lines, _orders_with_gaps, query, table, written
from tabspark.session import temporary_folder
from tabspark.sinks import dsv
from tabspark.sources import infer, options, readers, text
from tabspark.sources.memory import boxed_frame, to_frame
from tabspark.streaming import tables

_TEXTS: dict[tuple[str, str], str] = {}

# --- folders of text files

LINEITEM = {
    "l_orderkey": P.INT, "l_partkey": P.INT, "l_suppkey": P.INT, "l_linenumber": P.INT, "l_quantity": P.DOUBLE, "l_extendedprice": P.DOUBLE,
    "l_discount": P.DOUBLE, "l_tax": P.DOUBLE, "l_returnflag": P.TEXT, "l_linestatus": P.TEXT, "l_shipdate": P.TEXT,
}


@query("select round(avg(l_extendedprice), 4) as mean_price, round(avg(l_quantity), 4) as mean_quantity from lineitem")
def csv_two_column_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The means of two columns of a folder of delimited text, all of whose cells are parsed. The text is written at first use."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TEXTS:
        _TEXTS[key] = written(table(spark, folder, "lineitem"))
    lines = readers.read_table(spark, _TEXTS[key], infer.table_spec(LINEITEM))
    rounded = lambda c: F.round(c, 4)
    return folds.run(lines, mean_price=folds.mean(F.col("l_extendedprice")).map(rounded), mean_quantity=folds.mean(F.col("l_quantity")).map(rounded))


@query("select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def infer_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of 16 files with a header each, inferred and read; at sf0.1 and below none fills the inference prefix."""
    path = written(C.project(table(spark, folder, "customer"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment").repartition(16))
    return readers.read_table(spark, path, infer.infer_table(spark, path))


def _ranged_orders(spark: SparkSession, folder: str) -> str:
    """Orders by key in four files of unequal size."""
    orders = C.project(table(spark, folder, "orders"), "o_orderkey", "o_totalprice")
    share = F.col("o_orderkey") / orders.agg(F.max("o_orderkey")).scalar()
    part = F.when(share < 0.05, 0).when(share < 0.55, 1).when(share < 0.65, 2).otherwise(3)
    ranged = orders.withColumn("part", part).repartitionByRange(4, "part").sortWithinPartitions("o_orderkey").drop("part")
    return written(ranged)


ORDERS = infer.table_spec({"o_orderkey": P.INT, "o_totalprice": P.DOUBLE})


@query("select o_orderkey, cast(row_number() over (order by o_orderkey) - 1 as bigint) as _row_id from orders")
def file_places(spark: SparkSession, folder: str) -> DataFrame:
    """Places as read: files by path, lines in order."""
    return readers.read_table(spark, _ranged_orders(spark, folder), ORDERS, placed=True).select("o_orderkey", rows.ROW_ID)


@query("select cast(row_number() over (order by o_orderkey) - 1 as bigint) // 50 as chunk, o_orderkey from orders qualify (row_number() over (order by o_orderkey) - 1) % 50 = 0")
def file_chunk_heads(spark: SparkSession, folder: str) -> DataFrame:
    read = readers.read_table(spark, _ranged_orders(spark, folder), ORDERS, placed=True)
    return rows.chunk_heads(read, 50).select("chunk", "o_orderkey")


@query("""select a.o_orderkey, b.o_totalprice as next_price from (select *, row_number() over (order by o_orderkey) i from orders) a
  join (select *, row_number() over (order by o_orderkey) - 1 i from orders) b using (i)""")
def file_zip(spark: SparkSession, folder: str) -> DataFrame:
    """Each order with the price of the one after it: a table without its first row, zipped to itself, places as read."""
    read = readers.read_table(spark, _ranged_orders(spark, folder), ORDERS, placed=True)
    after = rows.drop_rows(read, 1).select(F.col("o_totalprice").alias("next_price"), rows.ROW_ID)
    return rows.zip_rows(read.select("o_orderkey", rows.ROW_ID), after)


@query("select c_custkey, c_name || ' é, ü' as c_name from customer")
def latin1_read(spark: SparkSession, folder: str) -> DataFrame:
    path = temporary_folder("latin") + "/files"
    accented = table(spark, folder, "customer").select("c_custkey", F.concat("c_name", F.lit(" é, ü")).alias("c_name"))
    accented.write.options(header=True, encoding="ISO-8859-1").csv(path)
    return readers.read_table(spark, path, infer.table_spec({"c_custkey": P.INT, "c_name": P.TEXT}, options.ParserOptions(encoding="ISO-8859-1")))


@query("""select event_id, ' "' || event_type as second, user_id || '" ' as third from events""")
def tokens_without_quoting(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat(F.col("event_id").cast("string"), F.lit(', "'), "event_type", F.lit(","), F.col("user_id").cast("string"), F.lit('" '))
    got = text.tokenize(table(spark, folder, "events").select(line.alias("value")), options.ParserOptions(quoting=options.NoQuoting()))
    return got.select(F.get("tokens", F.lit(0)).cast("bigint").alias("event_id"), F.get("tokens", F.lit(1)).alias("second"), F.get("tokens", F.lit(2)).alias("third"))


@query("select RowNum, coalesce(Description, '') as Description, X, Y from multiline where RowNum is not null and X is not null and Y is not null")
def other_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    """Quoted line breaks, through another tokenizer."""
    path = temporary_folder("multiline") + "/files"
    source = missing.fill(table(spark, folder, "multiline"), {"Description": ""})
    source.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(path)
    gen = options.RowGen(token_reader=lambda s, p: text.rfc4180_tokens(s, p, 4))
    spec = infer.infer_table(spark, path, gen)
    return readers.parse_strict(text.rfc4180_tokens(spark, path, 4).where(F.get("tokens", F.lit(0)) != "RowNum"), spec)


@query(f"select key, price, raw as price_raw from {_DIRTY}")
def parse_one_line(spark: SparkSession, folder: str) -> DataFrame:
    parsed = _dirty_lines(spark, folder).select(readers.parse_line(F.col("value"), ORDER_SPEC).alias("r"))
    return parsed.select(F.col("r.key.value").alias("key"), F.col("r.price.value").alias("price"), F.col("r.price.raw").alias("price_raw"))


@query(f"""select 'accepted' as outcome, count(*) as n from {_DIRTY} where price is not null and status is not null
  union all select 'rejected', count(*) from {_DIRTY} where price is null or status is null""")
def debug_read(spark: SparkSession, folder: str) -> DataFrame:
    path = temporary_folder("dirty") + "/files"
    dsv.write_lines(_dirty_lines(spark, folder), path)
    good, bad = readers.read_table_debug(spark, path, infer.table_spec(dict(zip(ORDER_SPEC.names, ORDER_SPEC.types, strict=True)), options.ParserOptions(header=ORDER_SPEC.names)))
    count = lambda df, name: df.agg(F.lit(name).alias("outcome"), F.count(F.lit(1)).alias("n"))
    return rows.concat(count(good, "accepted"), count(bad, "rejected"))


@query("""select o_orderkey, o_orderkey as whole, cast(o_orderkey as decimal(38, 0)) as wide, round(o_totalprice, 2) as price, o_totalprice > 1000 as dear,
  cast(o_orderkey % 100 as float) / 2 as half from orders""")
def typed_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers with ``.0`` and with thousands commas, truth values and floats, from their texts."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    truth = F.when(price > 1000, "TRUE").otherwise("false")
    cells = table(spark, folder, "orders").select("o_orderkey", F.concat(key.cast("string"), F.lit(".0")).alias("w"), F.format_number(price, 2).alias("p"), truth.alias("t"), (key % 100 / 2).cast("string").alias("h"))
    parse = lambda kind, c: kind.parse(F.col(c))
    return cells.select("o_orderkey", parse(P.INT64, "w").alias("whole"), parse(P.INTEGER, "w").alias("wide"), parse(P.DOUBLE, "p").alias("price"), parse(P.BOOL, "t").alias("dear"), parse(P.FLOAT, "h").alias("half"))


# --- inference and names


@query("""select * from (values ('code', 'Zip', 1000), ('at', 'TimeIn America/Chicago', 1000), ('price', 'Double', 1000), ('few', 'Text', 1000),
  ('code', 'Zip', 2), ('at', 'TimeIn America/Chicago', 2), ('price', 'Double', 2), ('few', 'Few', 2)) t(name, kind, line_budget)""")
def infer_custom_types(spark: SparkSession, folder: str) -> DataFrame:
    """A universe with types of the program, one of which takes at most two different texts, under two line budgets."""
    few = P.ParseType("Few", T.StringType(), lambda t: F.when(F.length(t) == 1, t), combine=lambda seen: len(seen) <= 2)
    code = F.lpad((F.col("o_orderkey") % 100_000).cast("string"), 5, "0")
    at = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    letter = F.substring(F.lit("abcdefghij"), (F.col("o_orderkey") % 10 + 1).cast("int"), F.lit(1))
    path = written(table(spark, folder, "orders").select(code.alias("code"), at.alias("at"), (F.col("o_totalprice") + 0.25).alias("price"), letter.alias("few")).coalesce(4))
    universe = options.with_types(P.ZIP, P.zoned_time("America/Chicago"), few)
    found = [(n, t.name, most) for most in (1000, 2) for spec in [infer.infer_table(spark, path, options.RowGen(universe=universe, lines=most))] for n, t in zip(spec.names, spec.types, strict=True)]
    return to_frame(spark, found, "name string, kind string, line_budget int")


@query("""select * from (values ('n_nationkey', 'EmpNNationkey', 'empNNationkey', 'Text'), ('n_name', 'EmpNName', 'empNName', 'Text'),
  ('class', 'EmpColClass', 'empColClass', 'Int'), ('1st', 'EmpCol1st', 'empCol1st', 'Double')) t(name, identifier, accessor, kind)""")
def column_names(spark: SparkSession, folder: str) -> DataFrame:
    """All columns as text, names and identifiers with a prefix, and declared columns."""
    path = written(C.project(table(spark, folder, "nation"), "n_nationkey", "n_name"))
    spec = infer.text_table(spark, path, options.RowGen(prefix="Emp")).with_column("class", P.INT)
    fields = [*spec.schema.fields, infer.declare("1st", P.DOUBLE, "Emp")]
    known = [f.metadata for f in fields]
    return to_frame(spark, [(f.name, m["identifier"], options.accessor(f.name, "Emp"), m["parse_type"]) for f, m in zip(fields, known, strict=True)], "name string, identifier string, accessor string, kind string")


@query("select n_nationkey as id, n_name as label from nation")
def names_given(spark: SparkSession, folder: str) -> DataFrame:
    """Files without a header line, with names given."""
    path = temporary_folder("bare") + "/files"
    nation = C.project(table(spark, folder, "nation"), "n_nationkey", "n_name")
    dsv.write_lines(nation.select(dsv.line_of(nation, "|").alias("line")), path)
    spec = infer.infer_table(spark, path, options.RowGen(names=("id", "label"), separator="|"))
    read = readers.read_table(spark, path, spec)
    return read.select(spec.columns.id.cast("int").alias("id"), spec.columns.label)


@query("select unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) as name")
def column_headers(spark: SparkSession, folder: str) -> DataFrame:
    return boxed_frame(spark, C.headers(table(spark, folder, "orders")), "string", "name")


@query("""select * from (values ('subset', 'true'), ('not a subset', 'false'), ('without', 's_suppkey,s_name'), ('replaced', 'string,string'), ('numbers', 's_acctbal')) t(what, answer)""")
def schema_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    whole = table(spark, folder, "supplier").schema
    part = C.schema_without(whole, ["s_nationkey", "s_acctbal"])
    texts = C.schema_replaced(part, T.StringType())
    found = [
        ("subset", str(C.schema_subset(part, whole)).lower()), ("not a subset", str(C.schema_subset(texts, whole)).lower()), ("without", ",".join(part.names)),
        ("replaced", ",".join(f.dataType.simpleString() for f in texts)), ("numbers", ",".join(C.columns_of_type(whole, T.DoubleType))),
    ]
    return to_frame(spark, found, "what string, answer string")


# --- records, cells and tagged values


@query("select n_nationkey, n_name, r_regionkey, r_name from nation join region on n_regionkey = r_regionkey")
def append_records(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select(F.struct("n_nationkey", "n_name").alias("a"), F.col("n_regionkey").alias("k"))
    regions = table(spark, folder, "region").select(F.struct("r_regionkey", "r_name").alias("b"), F.col("r_regionkey").alias("k"))
    return C.append_records(nations.join(regions, "k"), "a", "b")


@query("""select 'n_name :-> "' || n_name || '"' as plain, '(n_nationkey :-> ' || n_nationkey || ')' as bracketed from nation""")
def shown_in_parentheses(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "nation")
    return df.select(C.shown_field(df, "n_name").alias("plain"), C.shown_field(df, "n_nationkey", True).alias("bracketed"))


@query(f"select 'has ' || o_orderkey as o_orderkey, coalesce('has ' || o_orderpriority, 'none') as o_orderpriority from {GAPS}")
def map_cells(spark: SparkSession, folder: str) -> DataFrame:
    cells = C.project(_orders_with_gaps(spark, folder), "o_orderkey", "o_orderpriority")
    return missing.map_cells(cells, lambda c: F.concat(F.lit("has "), c.cast("string")), F.lit("none"))


@query(f"select coalesce(o_totalprice, -1) as price, coalesce(o_orderpriority, 'none') as priority from {GAPS}")
def zip_cells(spark: SparkSession, folder: str) -> DataFrame:
    """A record whose missing cells come from a record of defaults."""
    gaps = _orders_with_gaps(spark, folder)
    own = F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    return missing.zip_cells(gaps.select(own.alias("own"), F.struct(F.lit(-1.0).alias("price"), F.lit("none").alias("priority")).alias("others")), "own", "others", F.coalesce)


@query("select count(*) as n from lineitem")
def table_length(spark: SparkSession, folder: str) -> DataFrame:
    return boxed_frame(spark, [rows.length(table(spark, folder, "lineitem"))], "bigint", "n")


@query("select unnest([3, 1, 2])::bigint as value")
def boxed_values(spark: SparkSession, folder: str) -> DataFrame:
    return boxed_frame(spark, [3, 1, 2], "bigint")


_MELTED = "select 'c_name' as tag, c_name as text, null::double as double, c_custkey from customer union all select 'c_acctbal', null, c_acctbal, c_custkey from customer"


@query(_MELTED)
def melt_value_first(spark: SparkSession, folder: str) -> DataFrame:
    df = C.project(table(spark, folder, "customer"), "c_custkey", "c_name", "c_acctbal")
    return reshape.melt(df, ["c_custkey"], value_first=True).select("value.*", "c_custkey")


@query(f"select *, 2 as width, true as apart from ({_MELTED})")
def melt_by_row(spark: SparkSession, folder: str) -> DataFrame:
    df = C.project(table(spark, folder, "customer"), "c_custkey", "c_name", "c_acctbal")
    cells = reshape.melt_rows(df, ["c_custkey"]).select(F.inline("rows")).select("value.*", "c_custkey")
    return cells.withColumns({"width": F.lit(reshape.value_width(df, ["c_custkey"])), "apart": F.lit(reshape.disjoint(["c_custkey"], ["c_name"]))})


@query("""select c_custkey, 'c_name' as tag, upper(c_name) as text, null::double as double, 'c_name :-> "' || c_name || '"' as shown, upper(c_name) = c_name as same from customer
  union all select c_custkey, 'c_acctbal', null, c_acctbal * 2, 'c_acctbal', c_acctbal * 2 = c_acctbal from customer""")
def variant_map(spark: SparkSession, folder: str) -> DataFrame:
    df = C.project(table(spark, folder, "customer"), "c_custkey", "c_name", "c_acctbal")
    kinds, value = tagged.variants_of(df.schema, ["c_name", "c_acctbal"]), F.col("value")
    changed = reshape.melt(df, ["c_custkey"]).withColumn("new", kinds.map(value, {"text": F.upper, "double": lambda c: c * 2}))
    shown = F.when(value["tag"] == "c_name", kinds.show(value)).otherwise(F.split_part(kinds.show(value), F.lit(" "), F.lit(1)))
    return changed.select("c_custkey", "new.*", shown.alias("shown"), kinds.equal(value, F.col("new")).alias("same"))


# --- memory, sinks and streams


@query("select s_suppkey, s_name, (select count(*) from supplier) as n from supplier")
def kept_in_memory(spark: SparkSession, folder: str) -> DataFrame:
    n, kept = materialise.with_length(materialise.in_memory_after(table(spark, folder, "supplier"), lambda df: C.project(df, "s_suppkey", "s_name")))
    return materialise.force(kept).withColumn("n", F.lit(n).cast("bigint"))


@query("select r_regionkey as first, r_regionkey as second from region")
def replayed(spark: SparkSession, folder: str) -> DataFrame:
    again = materialise.replay(materialise.in_memory(table(spark, folder, "region"), "r_regionkey"))
    return to_frame(spark, [(a.r_regionkey, b.r_regionkey) for a, b in zip(again(), again(), strict=True)], "first int, second int")


@query("select c_name as line from customer")
def written_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = temporary_folder("lines") + "/files"
    dsv.write_lines(table(spark, folder, "customer").select("c_name"), path)
    return text.read_lines(spark, path).select(F.col("value").alias("line"))


@query("""select 'r_regionkey;r_name' as line union all select r_regionkey || ';"' || r_name || '"' from region""")
def printed_table(spark: SparkSession, folder: str) -> DataFrame:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        dsv.print_frame(C.project(table(spark, folder, "region"), "r_regionkey", "r_name"), ";")
    return to_frame(spark, [(line,) for line in out.getvalue().splitlines()], "line string")


@query("select '|' || rpad(cast(2 * max(r_regionkey) as varchar), 7, ' ') || '|' as line from region")
def previewed(spark: SparkSession, folder: str) -> DataFrame:
    """The printed rows of a preview, without frame and header."""
    top = table(spark, folder, "region").orderBy(F.col("r_regionkey").desc())
    with contextlib.redirect_stdout(io.StringIO()) as out:
        dsv.preview(top, lambda df: df.select((F.col("r_regionkey") * 2).alias("doubled")), 1)
    return to_frame(spark, [(line,) for line in out.getvalue().splitlines() if line.startswith("|") and "doubled" not in line], "line string")


@query("select c_custkey, c_name from customer")
def streamed_to_files(spark: SparkSession, folder: str) -> DataFrame:
    """Text files as a stream of rows, out as delimited files with headers, and read again."""
    spec = infer.table_spec({"c_custkey": P.INT, "c_name": P.TEXT})
    work, source = temporary_folder("stream"), written(C.project(table(spark, folder, "customer"), "c_custkey", "c_name"))
    tables.stream_to_dsv(tables.stream_table(spark, source, spec), f"{work}/out", f"{work}/state").awaitTermination()
    return readers.read_table(spark, f"{work}/out", spec)


@query("""select o_orderkey, cast(i as bigint) as _row_id, cast(i // 64 as bigint) as chunk from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders)
  where i >= 100 and i < 1000""")
def stream_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Rows 100 to 999 of a stream, in chunks of 64 rows of the stream."""
    work, source = temporary_folder("stream"), _ranged_orders(spark, folder)
    stream = tables.stream_table(spark, source, ORDERS, placed=True)
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{work}/out/batch={n}")
    tables.stream_placed(stream, f"{work}/state", keep, 100, 1000, 64).awaitTermination()
    return spark.read.parquet(f"{work}/out").select("o_orderkey", rows.ROW_ID, "chunk")
