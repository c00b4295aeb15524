"""FASTA records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequences import ordered_concat
from .lines import read_lines

_SPACE = " \\t\\n\\x0B\\f\\r"


def first_word(header) -> F.Column:
    """The first word after white space; null if there is none."""
    word = F.regexp_extract(header, f"\\A[{_SPACE}]*([^{_SPACE}]+)", 1)
    return F.when(word != "", word)


def parse_fasta(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (record_no, raw_name, sequence) and at most one error (message) of numbered lines.

    The error is the first in the file, or that there is no header; records that end
    before it are returned all the same.
    """
    header = F.startswith("line", F.lit(">"))
    marked = lines.withColumn("_header", F.coalesce(header, F.lit(False)).cast("long"))
    blocks = marked.groupBy("block").agg(F.sum("_header").alias("_n"))
    before = blocks.select("block", F.coalesce(F.sum("_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = F.sum("_header").over(Window.partitionBy("block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = marked.withColumn("_here", here).join(before, "block").withColumn("record_no", F.col("_here") + F.col("_before"))
    name = first_word(F.substring(F.col("line"), F.lit(2), F.length("line")))
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when((F.col("_header") == 1) & name.isNull(), F.lit("invalid FASTA header"))
        .when((F.col("_header") == 0) & (F.col("record_no") == 0) & (F.col("line") != ""), F.lit("sequence precedes first FASTA header"))
    )
    rows = rows.select("line_no", "record_no", "line", "_header", problem.alias("problem"), F.when(F.col("_header") == 1, name).alias("name"))
    first = rows.agg(
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("line_no"))).alias("message"),
        F.min(F.when(F.col("problem").isNotNull(), F.col("record_no") + F.when(F.col("_header") == 1, 0).otherwise(1))).alias("stop"),
        F.coalesce(F.sum("_header"), F.lit(0)).alias("headers"),
    )
    errors = first.select(F.coalesce("message", F.when(F.col("headers") == 0, F.lit("empty FASTA"))).alias("message")).where("message is not null")
    stop = F.broadcast(first.select("stop"))  # one row
    records = rows.where("record_no > 0").join(stop, F.col("stop").isNull() | (F.col("record_no") < F.col("stop")))
    records = records.groupBy("record_no").agg(F.max("name").alias("raw_name"), ordered_concat([F.col("line_no")], F.when(F.col("_header") == 1, "").otherwise(F.col("line"))).alias("sequence"))
    return records, errors


def read_fasta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and errors of one FASTA file, plain or gzip; OSError if it cannot be opened."""
    return parse_fasta(read_lines(spark, path))


def frame_fasta(spark: SparkSession, given) -> tuple[DataFrame, DataFrame]:
    """The same of sequences in memory: a DataFrame (name, sequence) or pairs."""
    if hasattr(given, "sparkSession"):
        rows = given.select(F.col("name").cast("string").alias("name"), F.col("sequence").cast("string").alias("sequence")).withColumn("record_no", F.monotonically_increasing_id() + 1)
    else:
        rows = spark.createDataFrame([(k + 1, n, s) for k, (n, s) in enumerate(given)] or [(0, "", "")], "record_no long, name string, sequence string").where("record_no > 0")
    records = rows.select("record_no", first_word(F.col("name")).alias("raw_name"), F.coalesce("sequence", F.lit("")).alias("sequence"))
    errors = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(first_word(F.col("name")).isNull()).alias("nameless"))
    message = F.when(F.col("n") == 0, "empty FASTA").when(F.col("nameless") > 0, "invalid FASTA header")
    return records.where("raw_name is not null"), errors.select(message.alias("message")).where("message is not null")
