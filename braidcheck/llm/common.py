"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: ASCII white space as the contracts define it: blank, tab, line feed, vertical tab, form feed, carriage return.
ASCII_BLANK = "[\\x20\\x09-\\x0D]+"


#: Rows and bytes that go to a Python worker at once. Whole texts are long, so Spark's own 10,000 rows would take much memory.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20
#: Stands for a null doc_id where rows go through Python, whose frames have no whole numbers that are null.
NO_ID = -(1 << 63)


def bound_batches(spark: SparkSession) -> None:
    """Settings of the session that the operators need, and that the lazy results that they return still need when they are read.

    Arrow batches hold BATCH_ROWS rows (fewer, if the session says so) and about BATCH_BYTES bytes at most, and shuffle
    files go when the query that wrote them ends, not when the driver happens to collect its garbage.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder that all executors share, the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a master that runs in one process (tests) gets a temporary folder, and any other an error.
    """
    bound_batches(spark)
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="braidcheck-")
        context.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/braid-{uuid.uuid4().hex[:12]}"
    for made in _scratch:
        made.append(path)
    return path


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Folders that shared_dir names within are deleted at the end; what was made from them must be written by then."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        for path in made:
            discard(spark, path)


def identified(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, NO_ID where it is null, text, and more columns; other columns go."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def id_or_null(doc_id: str = "doc_id") -> Column:
    return F.when(F.col(doc_id) != NO_ID, F.col(doc_id)).alias(doc_id)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet below folder and read it again."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more, through Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(spark: SparkSession) -> None:
    """One full collection of the driver's JVM, which shrinks its heap to what lives, after queries that leave many plans and tasks' events.

    A driver that is short of processors otherwise grows its heap to the limit, whatever little of it lives.
    """
    spark._jvm.System.gc()


def hand_back() -> None:
    """Hand back the memory that this process does not use any more."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """run, a generator over a task's batches, that hands back the memory it does not use any more when the task ends; workers live on."""

    @wraps(run)
    def over(batches):
        yield from run(batches)
        hand_back()

    return over


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
