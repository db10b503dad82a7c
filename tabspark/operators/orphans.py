"""References to records that do not exist at the time of the reference, kept up incrementally.

A parent's rows are periods of existence. A key's parents and references are swept in time order, a day at a time: what
holds at the start of a day is carried in from the key's earlier days, so a key's history is never gathered in one task.
Days of a key that hold more than a thousandth of all references are split further, over a bounded number of parts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import SchemaError
from tabspark.session import fresh, quoted

HOT_PARTS = 32
MOST_HOT = 1000


@dataclass(frozen=True)
class Names:
    """Names of the columns: the reference's key and time, the parent's key, first and last moment (the last not included)."""

    ref_key: str
    ref_time: str
    parent_key: str
    begins: str
    ends: str


def _day(t: Column) -> Column:
    return F.unix_date(t.cast("date"))


def classify(refs: DataFrame, parents: DataFrame, names: Names, cause: str = "cause") -> DataFrame:
    """Every reference with ``cause``: null if its parent exists at its time, else ``missing``, ``later`` or ``deleted``.

    ``missing``: no parent row has the key; ``later``: all rows with it begin after the reference; ``deleted``: any other
    case. A parent row exists from ``begins`` (included) to ``ends`` (not included; null: for ever); a row with null
    ``begins`` or an end not after its beginning never does. References with a null key refer to nothing and are left out;
    those with a null time have no parent at it (``missing``, or ``deleted`` if the key is known). Repeated rows on either
    side are kept or ignored, respectively; empty tables are fine; an existing column ``cause`` is replaced.
    """
    for name, df in ((names.ref_key, refs), (names.ref_time, refs), (names.parent_key, parents), (names.begins, parents), (names.ends, parents)):
        if name not in df.columns:
            raise SchemaError(f"no column {name!r}")
    if cause in refs.columns:
        refs = refs.drop(cause)
    zero = F.lit(0).cast("bigint")
    ref = refs.where(quoted(names.ref_key).isNotNull()).select(
        quoted(names.ref_key).alias("key"), quoted(names.ref_time).alias("t"), F.lit(2).alias("kind"), zero.alias("alive"), zero.alias("begun"), zero.alias("known"),
        F.struct(*[quoted(c) for c in refs.columns]).alias("ref"),
    )
    rows = parents.where(quoted(names.parent_key).isNotNull()).select(quoted(names.parent_key).alias("key"), quoted(names.begins).alias("b"), quoted(names.ends).alias("e")).distinct()
    lives = F.coalesce(F.col("e").isNull() | (F.col("e") > F.col("b")), F.lit(False)) & F.col("b").isNotNull()
    start = F.struct(F.col("b").alias("t"), lives.cast("bigint").alias("alive"), F.col("b").isNotNull().cast("bigint").alias("begun"), F.lit(1).cast("bigint").alias("known"))
    end = F.when(lives & F.col("e").isNotNull(), F.struct(F.col("e").alias("t"), F.lit(-1).cast("bigint").alias("alive"), zero.alias("begun"), zero.alias("known")))
    change = rows.select("key", F.explode(F.array(start, end)).alias("x")).where("x is not null")
    change = change.select("key", "x.t", F.lit(1).alias("kind"), "x.alive", "x.begun", "x.known", F.lit(None).cast(ref.schema["ref"].dataType).alias("ref"))
    change, ref = (df.withColumn("day", _day(F.col("t"))) for df in (change, ref))

    slim = ["key", "day", "alive", "begun", "known"]
    days = ref.select(*slim, F.lit(1).alias("n")).union(change.select(*slim, F.lit(0).alias("n")))
    days = days.groupBy("key", "day").agg(*[F.sum(c).alias(c) for c in ("alive", "begun", "known", "n")])
    so_far = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(c).over(so_far), zero).alias(c) for c in ("alive", "begun")]
    carry = days.select("key", "day", F.lit(None).cast(ref.schema["t"].dataType).alias("t"), F.lit(0).alias("kind"), *carried, F.sum("known").over(Window.partitionBy("key")).alias("known"), "n").where("n > 0").drop("n")

    # At most MOST_HOT rows can each hold more than that part of the sum, whatever the data.
    hot = days.where(F.col("n") * MOST_HOT > days.agg(F.sum("n")).scalar()).select(F.col("key").alias("hot_key"), F.col("day").alias("hot_day"))
    parts = lambda df: df.join(F.broadcast(hot), F.col("key").eqNullSafe(F.col("hot_key")) & F.col("day").eqNullSafe(F.col("hot_day")), "left")
    is_hot = F.col("hot_key").isNotNull()
    ref = parts(ref).withColumn("part", F.when(is_hot, F.pmod(F.xxhash64("ref"), F.lit(HOT_PARTS))).otherwise(0).cast("int"))
    every = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0))))
    carry = carry.select("*", F.lit(None).cast(ref.schema["ref"].dataType).alias("ref"))
    change = change.withColumn("known", zero)  # the carried row already has the key's whole number
    columns = ["key", "day", "t", "kind", "alive", "begun", "known", "ref", "part"]
    swept = ref.select(*columns)
    for df in (carry, change):
        swept = swept.unionByName(parts(df).withColumn("part", every).select(*columns))
    upto = Window.partitionBy("key", "day", "part").orderBy(F.col("t").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.select("kind", "ref", "t", *[F.sum(c).over(upto).alias(c) for c in ("alive", "begun", "known")])
    timed = F.col("t").isNotNull()
    verdict = F.when(timed & (F.col("alive") > 0), None).when(F.col("known") == 0, "missing").when(timed & (F.col("begun") == 0), "later").otherwise("deleted")
    return swept.where("kind = 2").select("ref.*", verdict.alias(cause))


class OrphanStore:
    """References, the parent index and the references that wait for a parent, kept in a folder over deliveries.

    Keys are spread over ``buckets``. Delivered references and parents are written once, each bucket apart, and never again.
    The references that wait are a table of their own; a delivery writes anew only its buckets that it touches. What belongs to
    the state is said by a log of one small file per delivery, put in place last: a delivery that failed half-way leaves
    nothing that counts, one that comes again is passed over, and a store opened on the folder goes on where the last
    stopped. The folder must be shared by all executors.
    """

    def __init__(self, spark: SparkSession, folder: str, names: Names, refs: T.StructType, parents: T.StructType, buckets: int = 64):
        self.spark, self.folder, self.names, self.buckets = spark, folder.rstrip("/"), names, buckets
        self.refs, self.parents = T.StructType([f for f in refs.fields if f.name != "cause"]), parents
        for name, schema in ((names.ref_key, refs), (names.ref_time, refs), (names.parent_key, parents), (names.begins, parents), (names.ends, parents)):
            if name not in schema.names:
                raise SchemaError(f"no column {name!r}")
        done = self._names("log")
        #: The number of deliveries, the last number of each source, and for each bucket the delivery that wrote its table.
        self.log = json.loads(self._read(f"log/{max(done, key=int)}")) if done else {"n": 0, "last": {}, "waiting": {}}

    def deliver(self, refs: DataFrame, parents: DataFrame, number: int | None = None, source: str = "") -> bool:
        """Takes in one delivery: new references probe the parent index, and references to keys whose parents changed are
        judged again, so arrivals resolve waiting orphans and deletions reopen them. Whether the delivery was new.

        A delivered parent row replaces earlier deliveries' rows of the same key and beginning (that is how a deletion
        comes); rows of one delivery stand side by side. References are never replaced. Deliveries of a ``source`` have
        rising numbers; without one it is the next.
        """
        last = self.log["last"].get(source, -1)
        number = last + 1 if number is None else number
        if number <= last:
            return False
        n, names = self.log["n"] + 1, self.names
        self._write("refs", n, refs.select(*[quoted(c) for c in self.refs.names]), names.ref_key)
        self._write("parents", n, parents.select(*[quoted(c) for c in self.parents.names]), names.parent_key)
        by_refs, by_parents = self._names(f"refs/{n}"), self._names(f"parents/{n}")
        touched = sorted({*by_refs, *by_parents})
        waiting = dict(self.log["waiting"])
        if touched:
            key = quoted(names.ref_key)
            changed = self._table("parents", [(n, b) for b in by_parents], self.parents).select(quoted(names.parent_key).alias("_k")).distinct()
            on = key == F.col("_k")
            new = self._table("refs", [(n, b) for b in by_refs], self.refs)
            again = self._table("refs", [(v, b) for v in range(1, n) for b in by_parents], self.refs).join(changed, on, "left_semi").unionByName(new)
            index = self._index(touched, n).join(again.select(key.alias("_k")).distinct(), quoted(names.parent_key) == F.col("_k"), "left_semi")
            before = self._table("waiting", [(waiting[b], b) for b in touched if b in waiting], self._waiting_schema)
            judged = classify(again, index, names).where("cause is not null")
            self._write("waiting", n, before.join(changed, on, "left_anti").unionByName(judged), names.ref_key)
            written = set(self._names(f"waiting/{n}"))
            for b in touched:
                waiting.pop(b, None)
                if b in written:
                    waiting[b] = n
        self.log = {"n": n, "last": {**self.log["last"], source: number}, "waiting": waiting}
        self._commit(n)
        return True

    @property
    def _waiting_schema(self) -> T.StructType:
        return T.StructType([*self.refs.fields, T.StructField("cause", T.StringType())])

    def waiting(self) -> DataFrame:
        """The references without a parent, with their ``cause``."""
        return self._table("waiting", [(n, b) for b, n in self.log["waiting"].items()], self._waiting_schema)

    def snapshot(self, table: str) -> DataFrame:
        """(table_name, period, cause, orphans): orphan references of the table per month of the reference and cause."""
        period = F.date_format(quoted(self.names.ref_time), "yyyy-MM")
        return self.waiting().groupBy(F.lit(table).alias("table_name"), period.alias("period"), "cause").agg(F.count(F.lit(1)).alias("orphans"))

    def _index(self, buckets: list[str], n: int) -> DataFrame:
        """The parents of some buckets: of the rows of a key and beginning those that were delivered last."""
        (version,) = fresh(self.parents.names, "_v")
        parts = [self._table("parents", [(v, b) for b in buckets], self.parents).withColumn(version, F.lit(v)) for v in range(1, n + 1) if self._held("parents", v, buckets)]
        if not parts:
            return self.spark.createDataFrame([], self.parents)
        rows = reduce(DataFrame.unionByName, parts)
        latest = F.max(version).over(Window.partitionBy(quoted(self.names.parent_key), quoted(self.names.begins)))
        return rows.withColumn("_last", latest).where(F.col("_last") == F.col(version)).drop("_last", version)

    # --- the folder

    def _held(self, kind: str, n: int, buckets: list[str]) -> bool:
        return bool(set(buckets) & set(self._names(f"{kind}/{n}")))

    def _write(self, kind: str, n: int, df: DataFrame, key: str) -> None:
        """The rows with a key, each bucket in a folder of its own; columns by place, whatever their names."""
        bucket = F.pmod(F.xxhash64(quoted(key)), F.lit(self.buckets)).cast("int")
        columns = [quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)]
        # A bucket in few files, but a large one over several tasks.
        rows = df.where(quoted(key).isNotNull()).select(*columns, bucket.alias("bucket")).hint("rebalance", F.col("bucket"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{kind}/{n}")
        self._known.pop(f"{kind}/{n}", None)

    def _table(self, kind: str, parts: list[tuple[int, str]], schema: T.StructType) -> DataFrame:
        """Rows of the given deliveries and buckets, as far as there are any."""
        paths = [f"{self.folder}/{kind}/{n}/{b}" for n, b in parts if self._held(kind, n, [b])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        kinds = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
        return self.spark.read.schema(kinds).parquet(*paths).toDF(*schema.names)

    @cached_property
    def _files(self):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @cached_property
    def _known(self) -> dict[str, list[str]]:
        return {}

    def _names(self, below: str) -> list[str]:
        """The names in a folder, but hidden ones; none if it is not there. A delivery's folders are looked at once."""
        if below not in self._known:
            path, files = self._files
            at = path(f"{self.folder}/{below}")
            found = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
            self._known[below] = [f for f in found if not f.startswith(("_", "."))]
        return self._known[below]

    def _read(self, below: str) -> str:
        path, files = self._files
        stream = files.open(path(f"{self.folder}/{below}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, n: int) -> None:
        path, files = self._files
        files.mkdirs(path(f"{self.folder}/log"))
        draft = path(f"{self.folder}/log/_{n}")
        stream = files.create(draft, True)
        stream.write(bytearray(json.dumps(self.log).encode()))
        stream.close()
        if not files.rename(draft, path(f"{self.folder}/log/{n}")):
            raise OSError(f"delivery {n} could not be logged in {self.folder}")
