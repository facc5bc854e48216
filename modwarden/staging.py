"""Tables written once to the folder that driver and executors share, and settings for texts of any size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to Python.  A batch ends at whichever comes first, so a batch of long texts
#: fits a worker; a single longer text is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 2_000, 1_000_000

#: Rows of one file of a staged table whose size is known.
FILE_ROWS = 50_000

#: The folders that staged() has written and nobody has discarded, with their session.
_kept: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset a temporary one, which only a
    session of one machine can do with."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = tempfile.mkdtemp(prefix="modwarden-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def folder(spark: SparkSession, name: str) -> str:
    """A new name for a folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that is deleted like a staged table."""
    path = folder(spark, name)
    _kept[path] = spark
    return path


def staged(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there and a lost executor costs no recomputation.

    The table stays until discard(), the end of a scope() around it or of the driver.  rows is a bound of its rows, where
    one is known: a table of far fewer files than a shuffle has partitions is put together first."""
    spark = df.sparkSession
    path = folder(spark, "staged")
    files = None if rows is None else max(1, -(-rows // FILE_ROWS))
    if files is not None and 4 * files <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(files)
    df.write.parquet(path)
    _kept[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(path: str) -> None:
    spark = _kept.pop(path, None)
    if spark is None:
        return
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; whoever owns the folder clears it
        pass


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more.  Others are left alone."""
    for t in tables:
        if path := getattr(t, "_staged_at", None):
            _delete(path)


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end what was staged inside, so write the result before: `with scope(): query(...).write...`."""
    before = set(_kept)
    try:
        yield
    finally:
        for path in [p for p in _kept if p not in before]:
            _delete(path)


@atexit.register
def _clear() -> None:
    for path in list(_kept):
        _delete(path)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Lowers the session's Arrow batches to `rows` rows and `size` bytes; lower settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan dealt out to all cores if its files give fewer partitions than there are; else as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.rdd().getNumPartitions() < cores else scan
