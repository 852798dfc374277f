"""Tables in the folder that driver and executors share, broadcasts behind a size check, and row numbers without a single task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that a table may have to be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20
#: Spark's setting by which a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a key table for one task.
TASK_ROWS = 10_000
#: Bytes of a value in a broadcast table, by type; a string is taken for a digest.
_WIDTH = {"boolean": 8, "int": 8, "bigint": 8, "double": 8, "date": 8, "string": 100}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a temporary one for a local
    master, whose tasks run on this machine; a cluster must name one."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: the lineage ends there, and a lost executor
    costs only the tasks that ran on it."""
    return written_at(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


class Scratch:
    """Written tables of one run of an operator, deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str, lean: bool = False):
        """lean: the shuffle files of a table go when it is written, not when the driver collects its garbage."""
        self.spark, self.path, self.lean = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", lean
        self.tables: dict[str, list[str]] = {}

    def written(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: about how many there are at most, so that a small table is not made by as many tasks as a large one."""
        if rows is not None:
            df = df.coalesce(max(1, min(partitions(self.spark), -(-rows // TASK_ROWS))))
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        self.tables.setdefault(name, []).append(path)
        if not self.lean:
            return written_at(df, path)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            return written_at(df, path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names; without names, all."""
        for path in [p for n in names for p in self.tables.pop(n, [])] if names else [self.path]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows were counted and fit the limit, else as it is.  Columns of unbounded width: never."""
    kinds = [kind for _, kind in df.dtypes]
    if any(k not in _WIDTH for k in kinds):
        return df
    rows = limit // (16 + sum(_WIDTH[k] for k in kinds))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with `name`, the place of each row in the order in which it is read, from 0 and gapless.

    The place inside a task's rows is known to the task; the tasks' counts, one row each, give the rest."""
    part, at, base, n, first = (_free(df, k) for k in ("part", "at", "base", "n", "first"))
    rows = written(df.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "numbered")
    tasks = rows.groupBy(part).agg(F.count("*").alias(n), F.min(at).alias(first))
    ahead = F.coalesce(F.sum(n).over(Window.partitionBy().orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(small_side(tasks.select(part, (ahead - F.col(first)).alias(base))), part).select(*df.columns, (F.col(base) + F.col(at)).alias(name))


def _free(df: DataFrame, name: str) -> str:
    """The name, behind as many underscores as no column of df begins with."""
    lead = "__"
    while any(c.startswith(lead) for c in df.columns):
        lead += "_"
    return lead + name
