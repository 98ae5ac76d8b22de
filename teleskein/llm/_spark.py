"""What the operators need from the session."""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was written out and is no larger than this in memory.
BROADCAST_BYTES = 16 << 20
#: Bytes of input that a part of a hash space stands for.
PART_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ready(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="teleskein-")
        sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder below spark.checkpoint.dir."""
    _ready(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder; shuffle files of the job that wrote it go at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


pin = table


def sized_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Write a join side out and broadcast it only if its measured bytes allow; else Spark shuffles. Columns of varying length are summed up, others count by their type."""
    df = pin(df)
    fixed, varying = 16, []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            varying.append(F.octet_length(column(f.name)))
        elif kind in ("array", "map", "struct"):
            varying.append(F.octet_length(F.to_json(F.struct(column(f.name)))))
        else:
            fixed += 8
    size = sum((F.coalesce(v, F.lit(0)) for v in varying), F.lit(fixed))
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def parts_for(df: DataFrame) -> int:
    """Parts of a hash space for what is derived from df: they follow the bytes of the tables that it reads, and are no fewer than the shuffle partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in read if x < 1 << 60)  # Spark says so where it doesn't know
    return max(partitions(df.sparkSession), min(-(-known // PART_BYTES), 1 << 18))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def column(name: str) -> Column:
    """A column of just this name, whatever signs are in it."""
    return F.col(quoted(name))


def release() -> None:
    """Give freed memory of this Python worker back to the system: workers are used again, and each keeps what its largest task once took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(run):
    """run, a function of batches or of tables, with release() after it."""

    @functools.wraps(run)
    def over_batches(batches):
        try:
            yield from run(batches)
        finally:
            release()

    @functools.wraps(run)
    def over_one(table):
        try:
            return run(table)
        finally:
            release()

    @functools.wraps(run)
    def over_two(left, right):
        try:
            return run(left, right)
        finally:
            release()

    if inspect.isgeneratorfunction(run):
        return over_batches
    return over_one if len(inspect.signature(run).parameters) == 1 else over_two


def row_struct(df: DataFrame) -> Column:
    """The whole row as one column, so that no name of the caller's can clash with a computed one."""
    return F.struct(*[column(c) for c in df.columns])
