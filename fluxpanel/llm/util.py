"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of this subpackage define it.
WHITESPACE = r"[\x20\x09-\x0D]+"
#: Bytes of rows that Spark gathers for a Python worker before it sends them.
BATCH = 4 << 20
#: What ``stored`` has written and ``discard`` hasn't deleted.
_WRITTEN: list[str] = []


def small_batches(spark: SparkSession) -> None:
    """Have Spark send rows to Python workers in batches of about ``BATCH`` bytes, one row at least, from now on.

    By default 10,000 rows or 64 MB are a batch: of whole texts that is held several times over,
    by every task in the JVM's direct memory and in its worker.  A smaller bound in bytes stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key, None) or "")
    if now is None or not 0 < int(now[1]) <= BATCH:
        spark.conf.set(key, str(BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent in a session of one JVM (tests), a temporary folder is made
    once and remembered in the session's settings; on a cluster that is an error.
    """
    for key in ("spark.checkpoint.dir", "spark.fluxpanel.scratch"):
        if found := spark.conf.get(key, None):
            return found.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="fluxpanel-")
    spark.conf.set("spark.fluxpanel.scratch", made)
    return made


#: Rows of a file of what ``stored`` writes, where it is told how many there are.
FILE_ROWS = 100_000


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    ``rows``, where given, is about the number of rows of numbers to be written: they go to
    four files for each core of the cluster, or to more of ``FILE_ROWS``, and not to one for each
    partition of a shuffle.  (For each file on a local disk Hadoop starts two processes, and
    until such a child runs its own program it counts as large as the executor.)

    The rows are then fixed even where an executor is lost later; a failed task of
    the write alone is run again by Spark.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fluxpanel-{label}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fluxpanel_path = path
    _WRITTEN.append(path)
    return out


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more.

    It does so once the driver's JVM has collected their owners; where lineage has been cut
    by ``stored``, waiting for that would keep the disks full.  Python's own references end a
    moment after they are collected, so the JVM is asked twice.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def discard(df: DataFrame | None) -> None:
    """Delete what ``stored`` wrote, once no later plan reads it."""
    path = getattr(df, "_fluxpanel_path", None)
    if path:
        _delete(df.sparkSession, path)


def written() -> frozenset[str]:
    """The tables that ``stored`` has written in this process so far and that are still there."""
    return frozenset(_WRITTEN)


def sweep(spark: SparkSession, before: frozenset[str], *keep: DataFrame) -> None:
    """Delete what ``stored`` has written since ``before``, but for what ``keep`` reads: for the end of a job."""
    kept = before | {getattr(df, "_fluxpanel_path", None) for df in keep}
    for path in [p for p in _WRITTEN if p not in kept]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Rows of so few ids and numbers are sent to every executor (tens of MB); more take part in a shuffle.
FEW = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """What ``stored`` returned, marked for a broadcast where it has few rows, else for a join by a shuffle: its files say how many."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


def without(docs: DataFrame, id_col: str, lost: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id isn't in the one column of ``lost``; null ids stay.

    While few ids are lost, texts stay where they are.
    """
    gone = stored(lost.toDF("__lost"), "lost")
    return docs.join(few(gone), F.col(id_col) == F.col("__lost"), "left_anti")
