"""Queries of the general data problems over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.operators import orphans, profile, rejects, timestamps
from tabspark.session import temporary_folder

Query = Callable[[SparkSession, str], DataFrame]
LOAD_KEYS = ["feed_no", "load_no"]
LINKS = orphans.Names("manager_id", "entered_at", "id", "created_at", "deleted_at")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _three_columns(spark: SparkSession, folder: str) -> profile.LoadProfile:
    return profile.LoadProfile(table(spark, folder, "issue114"), *LOAD_KEYS, ["oil_vol", "gas_vol", "well_status"], ["oil_vol", "gas_vol"])


def _all_columns(spark: SparkSession, folder: str) -> profile.LoadProfile:
    df = table(spark, folder, "issue114")
    return profile.LoadProfile(df, *LOAD_KEYS, [c for c in df.columns if c not in LOAD_KEYS])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The loads that differ from the load before, where well-formed is what the columns' induced expressions take."""
    return _three_columns(spark, folder).changes(["well_status"]).withColumnsRenamed({"feed": "feed_no", "load": "load_no"})


def p1_changes(spark: SparkSession, folder: str) -> DataFrame:
    """As p1_found, over every column. Text columns but the volumes are compared as categories, all others as numbers."""
    df = table(spark, folder, "issue114")
    text = [c for c, kind in df.dtypes if kind == "string" and c not in ("oil_vol", "gas_vol")]
    return _all_columns(spark, folder).changes(text).withColumnsRenamed({"feed": "feed_no", "load": "load_no"})


def p1_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Standard aggregates of every column per load."""
    return _all_columns(spark, folder).standard()


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every column per load that the column's expressions take, and those that they do not."""
    return _all_columns(spark, folder).summary().select("feed", "load", "column_name", "n_conforming", "n_ill")


def p1_coverage_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The loads of which every column's expressions take another share than of the load before."""
    return _all_columns(spark, folder).coverage_changes()


def p1_expressions(spark: SparkSession, folder: str) -> DataFrame:
    """The induced expressions of every text column, with the number of shapes that each takes."""
    found = _all_columns(spark, folder).expressions().where("expression is not null")
    return found.groupBy("column_name", "expression").agg(F.count(F.lit(1)).alias("shapes"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "users")
    return timestamps.normalise_timestamps(users, "signup_date", "zone").where("epoch_us is not null").select("id", "epoch_us").distinct()


def p3_status(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of users by what came of their signup_date."""
    users = table(spark, folder, "users")
    return timestamps.normalise_timestamps(users, "signup_date", "zone").groupBy("ts_status").agg(F.count(F.lit(1)).alias("n"))


def _split(spark: SparkSession, folder: str, with_fields: bool, file: str | None = None) -> tuple[DataFrame, dict]:
    layout = rejects.read_layout(table(spark, folder, "raw_columns"))
    records = table(spark, folder, "raw_records").select("raw_id", "file_name", "record")
    if file is not None:
        records = records.where(F.col("file_name") == file)  # before the split, whose Python step no filter passes
    return rejects.split_records(records, "record", "file_name", layout, with_fields), layout


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    split, _ = _split(spark, folder, False)
    return split.where("reason is not null").select("raw_id", "reason").distinct()


def p5_valid(name: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        split, layout = _split(spark, folder, True, name)
        return rejects.valid_rows(split, "file_name", name, layout, ["raw_id"])

    query.__doc__ = f"The valid records of {name} as typed rows."
    return query


def _orphans(spark: SparkSession, folder: str, years: int = 3) -> orphans.OrphanStore:
    """The store after employees and managers have come in deliveries of some ``years`` each, as they did: a manager's row
    comes when it begins, with no end if that is later, and again when it ends. Employees without a time come first.
    """
    refs = table(spark, folder, "employees").select("id", "manager_id", "entered_at")
    parents = table(spark, folder, "managers").select("id", "created_at", "deleted_at")
    store = orphans.OrphanStore(spark, temporary_folder("orphans", spark), LINKS, refs.schema, parents.schema, 8)
    times = refs.select(F.col("entered_at").alias("t")).union(parents.select(F.explode(F.array("created_at", "deleted_at"))))
    span = times.agg(F.min(F.year("t")).alias("first"), F.max(F.year("t")).alias("last")).first()
    first, last = (span.first, span.last) if span.first is not None else (0, 0)
    period = lambda c: F.floor((F.year(c) - first) / years)
    came, entered = F.coalesce(period("created_at"), F.lit(0)), F.coalesce(period("entered_at"), F.lit(0))
    # All rows of a key and beginning come again when one of them changes, so that they stand side by side.
    events = parents.select(F.col("id").alias("_k"), F.col("created_at").alias("_b"), F.explode(F.array(came, period("deleted_at"))).alias("_p")).distinct()
    same = F.col("id").eqNullSafe(F.col("_k")) & F.col("created_at").eqNullSafe(F.col("_b"))
    for number in range((last - first) // years + 1):
        known = parents.where(came <= number).withColumn("deleted_at", F.when(period("deleted_at") <= number, F.col("deleted_at")))
        store.deliver(refs.where(entered == number), known.join(events.where(F.col("_p") == number), same, "left_semi"), number)
    return store


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _orphans(spark, folder).waiting()
    return found.select("id", "manager_id", F.date_format("entered_at", "yyyy-MM").alias("period"), "cause").distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references of employees per month and cause, rows counted as delivered."""
    return _orphans(spark, folder).snapshot("employees")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_changes": p1_changes,
    "p1_profile": p1_profile,
    "p1_coverage": p1_coverage,
    "p1_coverage_changes": p1_coverage_changes,
    "p1_expressions": p1_expressions,
    "p3_found": p3_found,
    "p3_status": p3_status,
    "p5_found": p5_found,
    "p5_multiline": p5_valid("multiline.csv"),
    "p5_prestige": p5_valid("prestige.csv"),
    "p5_issue114": p5_valid("issue114.csv"),
    "p6_found": p6_found,
    "p6_report": p6_report,
}

_ORPHAN_SQL = """
select e.id, e.manager_id, strftime(e.entered_at, '%Y-%m') as period,
  case when not exists (select 1 from managers m where m.id = e.manager_id) then 'missing'
    when not exists (select 1 from managers m where m.id = e.manager_id and not coalesce(m.created_at > e.entered_at, false)) then 'later'
    else 'deleted' end as cause
from employees e
where e.manager_id is not null and not exists (
  select 1 from managers m where m.id = e.manager_id and m.created_at <= e.entered_at and (m.deleted_at is null or m.deleted_at > e.entered_at))
"""

_PROFILE_COLUMNS = [
    "line_id", "report_month", "report_year", "ST", "api_county_code", "api_seq_num", "sidetrack_num", "formation_code", "well_status", "prod_days",
    "water_disp_code", "oil_vol", "gas_vol", "operator_num", "name", "facility_name", "facility_num", "revised",
]


def _profile_sql() -> str:
    # Doubles and times are printed differently by the two engines but are as distinct, so these are profiled as they are.
    other = [
        "water_vol", "water_press_tbg", "water_press_csg", "bom_invent", "oil_sales", "adjustment", "eom_invent", "gravity_sales", "gas_sales",
        "flared", "shrink", "gas_prod", "btu_sales", "gas_press_tbg", "gas_press_csg",
    ]
    number = r"regexp_full_match(v, '-?[0-9]+(\.[0-9]+)?')"
    text = lambda c: f"select feed_no, load_no, '{c}' column_name, trim(cast(\"{c}\" as varchar), ' ') v, null::double x from issue114"
    real = lambda c: f"select feed_no, load_no, '{c}', cast(\"{c}\" as varchar), \"{c}\" from issue114"
    parts = [text(c) for c in [*_PROFILE_COLUMNS, "accepted_date"]] + [real(c) for c in other]
    return f"""
with cells as ({' union all '.join(parts)}),
kept as (select feed_no, load_no, column_name, case when v in ('', 'NA') then null else v end v, x from cells)
select feed_no as feed, load_no as load, column_name, count(*) as n_rows, cast(count(*) - count(v) as bigint) as n_missing, count(distinct v) as n_distinct,
  min(case when x is not null then x when {number} then cast(v as double) end) as minimum,
  max(case when x is not null then x when {number} then cast(v as double) end) as maximum
from kept group by feed_no, load_no, column_name
"""


_CHANGES_SQL = r"""
with cells as (
  select feed_no, load_no, 'oil_vol' column_name, trim(oil_vol, ' ') v from issue114
  union all select feed_no, load_no, 'gas_vol', trim(gas_vol, ' ') from issue114
  union all select feed_no, load_no, 'well_status', trim(well_status, ' ') from issue114),
judged as (
  select feed_no, load_no, column_name, case when v is null or v in ('', 'NA') then null else v end v,
    case when column_name = 'well_status' then regexp_full_match(v, '[A-Z]{2}') else regexp_full_match(v, '-?[0-9]+(\.[0-9]+)?') end formed from cells),
numbers as (
  select *, case when column_name <> 'well_status' and v is not null and formed then cast(v as double) end x from judged),
facts as (
  select feed_no, load_no, column_name, count(*) n, count(*) - count(v) missing, count(v) there, count(distinct v) d,
    count(*) filter (v is not null and not formed) ill, max(x) hi, min(x) lo, quantile_cont(x, 0.5) med
  from numbers group by all),
pairs as (
  select a.*, b.n n0, b.missing missing0, b.there there0, b.d d0, b.ill ill0, b.hi hi0, b.lo lo0, b.med med0, b.load_no before_no
  from (select *, lag(load_no) over (partition by feed_no, column_name order by load_no) prev from facts) a
  join facts b on a.feed_no = b.feed_no and a.column_name = b.column_name and a.prev = b.load_no),
shares as (
  select feed_no, load_no, v, count(*) c from judged where column_name = 'well_status' and v is not null group by all),
moved as (
  select p.feed_no, p.load_no, s.v, s.c * p.there0 s, p.there * p.there0 scale from pairs p join shares s on s.feed_no = p.feed_no and s.load_no = p.load_no
  where p.column_name = 'well_status'
  union all
  select p.feed_no, p.load_no, s.v, -s.c * p.there, p.there * p.there0 from pairs p join shares s on s.feed_no = p.feed_no and s.load_no = p.before_no
  where p.column_name = 'well_status'),
apart as (
  select feed_no, load_no from (select feed_no, load_no, v, sum(s) s, max(scale) scale from moved where scale > 0 group by all)
  group by all having sum(abs(s)) * 2 > max(scale))
select feed_no, load_no, column_name, 'null_share' as finding from pairs where abs(missing * n0 - missing0 * n) * 10 > n * n0
union all select feed_no, load_no, column_name, 'distinct_count' from pairs where d > 2 * d0 or d0 > 2 * d
union all select feed_no, load_no, column_name, 'pattern' from pairs where there > 0 and there0 > 0 and abs(ill * there0 - ill0 * there) * 20 > there * there0
union all select feed_no, load_no, column_name, 'value_range' from pairs
  where column_name <> 'well_status' and (coalesce(lo < 0, false) <> coalesce(lo0 < 0, false) or hi > 10 * hi0 or hi0 > 10 * hi)
union all select feed_no, load_no, column_name, 'distribution' from pairs where column_name <> 'well_status' and (med > 2 * med0 or med0 > 2 * med)
union all select feed_no, load_no, 'well_status', 'distribution' from apart
"""

_FIELDS_SQL = r"""
with recursive texts as (select raw_id, file_name, case when record like '%' || chr(13) then left(record, length(record) - 1) else coalesce(record, '') end as t from raw_records),
walk as (
  select raw_id, file_name, 0 as n, null::varchar as field, false as quoted, t as rest, false as broken from texts
  union all
  select raw_id, file_name, n + 1,
    case when not opens then trim(case when comma > 0 then left(rest, comma - 1) else rest end, ' ') when close > 0 then substr(rest, 2, close - 1) else substr(rest, 2, length(rest) - 2) end,
    opens,
    case when not opens then case when comma > 0 then substr(rest, comma + 1) end when close > 0 then substr(rest, close + 3) end,
    case when opens then close = 0 and not (length(rest) > 1 and rest like '%"') else contains(case when comma > 0 then left(rest, comma - 1) else rest end, '"') end
  from (select *, rest like '"%' as opens, strpos(rest, ',') as comma, case when rest like '"%' then strpos(substr(rest, 2), '",') else 0 end as close from walk where rest is not null and not broken)),
fields as (select * from walk where n > 0),
wanted as (select file_name, count(*) as columns from raw_columns group by file_name),
records as (
  select f.raw_id, f.file_name, bool_or(f.broken) as broken, max(f.n) as fields, any_value(w.columns) as columns
  from fields f join wanted w using (file_name) group by f.raw_id, f.file_name),
values_ as (
  select f.raw_id, c.col_no, c.col_name, f.field, f.quoted,
    f.field not in ('', 'NA') and ((c.col_type = 'int' and not regexp_full_match(f.field, '-?[0-9]+(\.0)?'))
      or (c.col_type = 'double' and not regexp_full_match(replace(f.field, ',', ''), '-?[0-9]+(\.[0-9]+)?'))) as bad
  from fields f join raw_columns c on c.file_name = f.file_name and c.col_no = f.n),
judged as (
  select raw_id, file_name, case when broken then 'quoting' when fields <> columns then 'column_count' when exists (select 1 from values_ v where v.raw_id = r.raw_id and v.bad) then 'bad_value' end as reason
  from records r)
"""


def _valid_sql(file: str, columns: list[tuple[str, str]]) -> str:
    """The columns of TESTDATA.md's file, by name and type, of its valid records."""
    text = lambda n: f"max(case when col_no = {n} then case when quoted then replace(field, '\"\"', '\"') else field end end)"
    cell = {
        "text": text,
        "int": lambda n: f"try_cast(regexp_replace(nullif(nullif({text(n)}, ''), 'NA'), '\\.0$', '') as bigint)",
        "double": lambda n: f"try_cast(replace(nullif(nullif({text(n)}, ''), 'NA'), ',', '') as double)",
    }
    cells = ", ".join(f'{cell[kind](n)} as "{name}"' for n, (name, kind) in enumerate(columns, 1))
    return f"{_FIELDS_SQL} select raw_id, {cells} from values_ join judged using (raw_id) where reason is null and file_name = '{file}' group by raw_id"


def _instants_sql() -> str:
    zone = r"(?: ?([+-])([0-9]{2})(?::?([0-9]{2}))?| ?([A-Za-z][A-Za-z0-9_+-]*(?:/[A-Za-z0-9_+-]+)*)|\[([^\]]+)\])?"
    tail = ["sg", "oh", "om", "zn", "br"]
    clock = r"(?: ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?"
    half = r"(?: ([AaPp][Mm]))?"
    read = [  # a pattern and the parts that its groups are
        (r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?" + zone + ")?", ["y", "mo", "d", "h", "mi", "se", "fr", *tail]),
        (r"([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})" + zone, ["y", "mo", "d", "h", "mi", "se", *tail]),
        (r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})" + clock + half + zone + ")?", ["mo", "d", "y", "h", "mi", "se", "ap", *tail]),
        (r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})" + clock + zone + ")?", ["d", "mo", "y", "h", "mi", "se", *tail]),
        (r"(?:([A-Za-z]{3,9}), )?([0-9]{1,2}) ([A-Za-z]{3,9}) ([0-9]{4})" + clock + zone + ")?", ["wd", "d", "nm", "y", "h", "mi", "se", *tail]),
        (r"([A-Za-z]{3,9}) ([0-9]{1,2}), ([0-9]{4})" + clock + half + zone + ")?", ["nm", "d", "y", "h", "mi", "se", "ap", *tail]),
    ]
    parts = ["y", "mo", "d", "h", "mi", "se", "fr", "ap", "wd", "nm", *tail]
    union = " union all ".join(
        f"select id, z, {', '.join(f'm.{p}' if p in own else f'null as {p}' for p in parts)} from (select id, z, regexp_extract(s, '^(?:{form})$', {own}) as m from t where regexp_full_match(s, '{form}'))" for form, own in read
    )
    abbreviations = ", ".join(f"('{name}', {minutes})" for name, minutes in timestamps.ABBREVIATIONS.items())
    return f"""
with t as (select id, trim(signup_date, ' ') as s, coalesce(zone, 'America/Chicago') as z from users),
parts as ({union}),
filled as (select id, z, {", ".join(f"nullif({p}, '') as {p}" for p in parts)} from parts),
clocked as (select *, cast(y as bigint) as year, coalesce(cast(mo as bigint), case when lower(nm) in (select lower(monthname(make_date(2000, i, 1))) from range(1, 13) r(i)) or lower(nm) in (select lower(left(monthname(make_date(2000, i, 1)), 3)) from range(1, 13) r(i))
    then list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(left(nm, 3))) end) as month,
  case when ap is null then coalesce(cast(h as bigint), 0) when cast(h as bigint) between 1 and 12 then cast(h as bigint) % 12 + case when lower(ap) = 'pm' then 12 else 0 end else 99 end as hour from filled),
walls as (select *, try(make_timestamp(year, month, cast(d as bigint), hour, coalesce(cast(mi as bigint), 0), cast(coalesce(cast(se as bigint), 0) as double))) as wall,
  cast(rpad(left(coalesce(fr, '0'), 6), 6, '0') as bigint) as micro from clocked where hour <= 23 and coalesce(cast(mi as bigint), 0) <= 59 and coalesce(cast(se as bigint), 0) <= 59 and year > 0),
dated as (select w.*, a.minutes from walls w left join (values {abbreviations}) a(name, minutes) on a.name = upper(coalesce(zn, br)) where wall is not null
  and (wd is null or lower(wd) in (lower(dayname(wall)), lower(left(dayname(wall), 3)))) and (sg is null or cast(oh as bigint) <= 18 and coalesce(cast(om as bigint), 0) <= 59)),
offset_known as (select id, epoch_us(wall) + micro - 60000000 * case when sg is not null then (case when sg = '-' then -1 else 1 end) * (cast(oh as bigint) * 60 + coalesce(cast(om as bigint), 0)) else minutes end as us
  from dated where sg is not null or minutes is not null),
placed as (select id, wall, micro, coalesce(zn, br, z) as place from dated where sg is null and minutes is null and coalesce(zn, br, z) in (select name from pg_timezone_names())),
guessed as (select *, timezone(place, wall) as u from placed),
fitting as (select id, wall, micro, place, timezone('UTC', u) + to_minutes(k) as utc from guessed, (values (0), (30), (60), (120), (-30), (-60), (-120)) m(k) where timezone(place, u + to_minutes(k)) = wall),
zoned as (select id, epoch_us(any_value(utc)) + any_value(micro) as us from fitting group by id, wall, micro, place having count(distinct utc) = 1),
epochs as (select id, cast(s as bigint) * case when length(s) = 10 then 1000000 else 1000 end as us from t where regexp_full_match(s, '[0-9]{{10}}|[0-9]{{13}}'))
select distinct id, us as epoch_us from (select * from offset_known union all select * from zoned union all select * from epochs)
"""


# The columns of issue114.csv that are no text, and the others, in their order.
ISSUE114_NUMBERS = {"line_id": "int", "report_month": "int", "report_year": "int", "prod_days": "int", "oil_vol": "double", "gas_vol": "double", "operator_num": "int"}
ISSUE114 = (
    "line_id report_month report_year ST api_county_code api_seq_num sidetrack_num formation_code well_status prod_days water_disp_code water_vol "
    "water_press_tbg water_press_csg bom_invent oil_vol oil_sales adjustment eom_invent gravity_sales gas_sales flared gas_vol shrink gas_prod btu_sales "
    "gas_press_tbg gas_press_csg operator_num name facility_name facility_num accepted_date revised"
).split()


ORACLES: dict[str, str] = {
    "p3_found": _instants_sql(),
    "p5_found": f"{_FIELDS_SQL} select raw_id, reason from judged where reason is not null",
    "p5_multiline": _valid_sql("multiline.csv", [("RowNum", "int"), ("Description", "text"), ("X", "int"), ("Y", "int")]),
    "p5_prestige": _valid_sql(
        "prestige.csv", [("job", "text"), ("education", "double"), ("income", "int"), ("women", "double"), ("prestige", "double"), ("census", "int"), ("type", "text")]
    ),
    "p5_issue114": _valid_sql("issue114.csv", [(c, ISSUE114_NUMBERS.get(c, "text")) for c in ISSUE114]),
    "p1_found": _CHANGES_SQL,
    "p1_profile": _profile_sql(),
    "p6_found": f"select distinct * from ({_ORPHAN_SQL})",
    "p6_report": f"select 'employees' as table_name, period, cause, count(*) as orphans from ({_ORPHAN_SQL}) group by period, cause",
}
