"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.errors import SchemaError

_WRITTEN: list[tuple[SparkSession, str]] = []
_LOCAL: dict[str, str] = {}  # of local sessions that name no folder, by application

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", app: str = "tabspark", **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` where Spark's have a point."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: what the session names in ``spark.checkpoint.dir``, or has set as checkpoint folder.

    Where it names none, a local session gets a folder of this machine; any other one is refused, as its executors could
    not read each other's files there.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(context.applicationId)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise SchemaError("name a folder that all executors share in spark.checkpoint.dir")
    _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="tabspark-")
    atexit.register(shutil.rmtree, _LOCAL[context.applicationId], ignore_errors=True)
    return _LOCAL[context.applicationId]


def temporary_folder(prefix: str, spark: SparkSession | None = None) -> str:
    """A new folder's name below the shared one. It is removed when the program ends, or by remove_written before."""
    spark = spark or SparkSession.getActiveSession()
    folder = f"{shared_folder(spark)}/{prefix}-{os.urandom(8).hex()}"
    if not _WRITTEN:
        atexit.register(remove_written)
    _WRITTEN.append((spark, folder))
    return folder


def remove_written() -> None:
    """Removes the folders of temporary_folder and cut_lineage. Tables read from them can't be read again."""
    while _WRITTEN:
        spark, folder = _WRITTEN.pop()
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended
            if folder.startswith(("/", "file:")):
                shutil.rmtree(re.sub("^file:/*", "/", folder), ignore_errors=True)


def _fits_parquet(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and len({f.name.lower() for f in kind.fields}) == len(kind.fields) and all(_fits_parquet(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _fits_parquet(kind.elementType)
    if isinstance(kind, T.MapType):
        return _fits_parquet(kind.keyType) and _fits_parquet(kind.valueType)
    return isinstance(kind, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows, so that lost executors cost no recomputation.

    It is a Parquet table, of which later steps read only the columns and rows they need. Types that Parquet does not hold
    go through Spark's own checkpoint in the same folder.
    """
    spark = df.sparkSession
    names = [f"c{i}" for i in range(len(df.columns))]
    if not df.columns or not all(_fits_parquet(f.dataType) for f in df.schema.fields):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared_folder(spark))
        return df.checkpoint()
    path = temporary_folder("rows", spark)
    df.toDF(*names).write.parquet(path)
    kinds = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)])
    read = spark.read.schema(kinds).parquet(path)
    return read.select(*[F.col(n).alias(f.name, metadata=f.metadata) for n, f in zip(names, df.schema.fields, strict=True)])


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that clash, ignoring case, with none of ``taken``."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def pinned(value: Column) -> Column:
    """``value``, worked out once per row: the optimizer can't copy it into each place that uses it, nor push those below it.

    Long chains of derived columns otherwise grow exponentially when a filter on the last is pushed to the scan.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def apart(value: Column) -> Column:
    """``value``, with its projection outside whole-stage code, where Spark splits long expressions into small methods.

    One generated method for a long chain of steps is beyond what the JVM compiles, and is then interpreted.
    """
    return F.get(F.transform(F.array(value), lambda x: x), F.lit(0))


def quoted(name: str) -> Column:
    """The top-level column of that exact name, points and backticks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")
