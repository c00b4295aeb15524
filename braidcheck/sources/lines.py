"""Numbered lines of plain or gzip files, found out by content, through Spark's own readers."""

from __future__ import annotations

import re
import uuid
import zlib

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINES = "block long, line_no long, line string, error string"
#: Suffixes from which Spark's text reader infers a codec, whatever the content.
CODED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".zstd")
#: gzip files up to this size are one row that a task decompresses piece by piece; the text reader streams larger ones.
WHOLE_FILE = 64 << 20


def probe(spark: SparkSession, path: str) -> tuple[str, int]:
    """("gzip" or "plain", bytes) by the first two bytes; OSError if the file cannot be opened."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        stream = store.open(where)
        try:
            magic = (stream.read(), stream.read())
        finally:
            stream.close()
        return ("gzip" if magic == (0x1F, 0x8B) else "plain"), store.getFileStatus(where).getLen()
    except Exception as error:
        raise OSError("cannot open input") from error


def _literal(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _inflate(content: bytes, gzip: bool):
    """(line, error) of a whole file; concatenated gzip members follow each other."""
    if not gzip:
        lines = content.split(b"\n")
        yield from ((x, None) for x in (lines[:-1] if lines[-1] == b"" else lines))
        return
    rest, error = b"", None
    machine = zlib.decompressobj(31)
    at = 0
    while at < len(content):
        piece = content[at : at + (1 << 20)]
        at += len(piece)
        try:
            out = machine.decompress(piece)
            while machine.eof and machine.unused_data:
                left, machine = machine.unused_data, zlib.decompressobj(31)
                out += machine.decompress(left)
        except zlib.error as e:
            error = str(e)
            break
        lines = (rest + out).split(b"\n")
        rest = lines.pop()
        yield from ((x, None) for x in lines)
    if rest:
        yield rest, None
    if error is None and not machine.eof:
        error = "unexpected end of file"
    if error is not None:
        yield None, error


def _under_suffix(spark: SparkSession, path: str, suffix: str) -> str:
    """A copy of a file under a name of that suffix, by which the text reader tells the codec, in the folder that executors share. It goes when the driver does."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise OSError("spark.checkpoint.dir is needed to read a large file whose name does not tell its compression")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/braid-{uuid.uuid4().hex}{suffix}")
    store = new.getFileSystem(conf)
    jvm.org.apache.hadoop.fs.FileUtil.copy(old.getFileSystem(conf), old, store, new, False, conf)
    store.deleteOnExit(new)
    return new.toString()


def _damage(spark: SparkSession, path: str) -> str | None:
    """Why a compressed file cannot be read to its end; null if it can."""
    try:
        spark.read.option("lineSep", "\n").text(_literal(path)).count()
    except (PySparkException, Py4JError) as error:
        if "FAILED_READ_FILE" not in str(error):
            raise
        return "unexpected end of file" if "nexpected end of" in str(error) else "damaged gzip data"
    return None


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, line_no from 1, line, error) of one file; lines end at a line feed and lose one carriage return before it.

    Plain files are split among tasks; each split counts its own lines, and a row per split
    holds what comes before. gzip content under any name and of any size is read in one task that holds a piece at a
    time. Damage in a small gzip file is the row after the lines before it; a large one is read through first, and is that row alone.
    """
    kind, size = probe(spark, path)
    small = size <= WHOLE_FILE and (kind == "gzip" or path.lower().endswith(CODED))
    if not small and kind == "gzip" and not path.endswith(".gz"):
        path = _under_suffix(spark, path, ".gz")
    elif not small and kind == "plain" and path.lower().endswith(CODED):
        path = _under_suffix(spark, path, ".txt")
    damage = _damage(spark, path) if kind == "gzip" and not small else None
    if damage:
        rows = spark.createDataFrame([(0, 1, None, damage)], LINES)
    elif small:

        def run(batches):
            for pdf in batches:
                for content in pdf["content"].tolist():
                    held, n = [], 0
                    for line, error in _inflate(bytes(content), kind == "gzip"):
                        n += 1
                        held.append((0, n, None if line is None else line.decode("utf-8", "replace"), error))
                        if len(held) >= 50_000:
                            yield pd.DataFrame(held, columns=["block", "line_no", "line", "error"])
                            held = []
                    yield pd.DataFrame(held, columns=["block", "line_no", "line", "error"])

        rows = spark.read.format("binaryFile").load(_literal(path)).select("content").mapInPandas(run, LINES)
    else:
        text = spark.read.option("lineSep", "\n").text(_literal(path)).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
        blocks = text.groupBy("block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        blocks = blocks.select("block", "_first", before.alias("_before"))
        rows = text.join(blocks, "block").select("block", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "line", F.lit(None).cast("string").alias("error"))
    bare = F.when(F.endswith("line", F.lit("\r")), F.substring(F.col("line"), F.lit(1), F.length("line") - 1)).otherwise(F.col("line"))
    # A mark of this call in the plan: a file that changed is never answered from what an earlier call keeps of it.
    return rows.withColumn("line", bare).where(F.lit(uuid.uuid4().hex) != "")
