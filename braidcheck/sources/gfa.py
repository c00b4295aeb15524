"""GFA records: tab-separated lines, dispatched by their first field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import blunt, invalid_symbol, is_valid, number, path_steps, segment_key, walk_steps
from .lines import read_lines

DEFAULT_VERSION = "inferred-1.x"


def read_gfa(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, fields, error) of one GFA file; OSError if it cannot be opened."""
    return fields_of(read_lines(spark, path))


def fields_of(lines: DataFrame) -> DataFrame:
    return lines.select("line_no", F.split("line", "\t", -1).alias("fields"), *(["error"] if "error" in lines.columns else []))


def records(gfa: DataFrame, kind: str) -> DataFrame:
    return gfa.where(F.get("fields", F.lit(0)) == kind)


def header_version(gfa: DataFrame) -> DataFrame:
    """One row: the last VN:Z: tag of all H lines, or the default."""
    tags = records(gfa, "H").select("line_no", F.posexplode("fields").alias("place", "tag")).where((F.col("place") > 0) & F.startswith("tag", F.lit("VN:Z:")))
    last = tags.agg(F.max_by(F.substring(F.col("tag"), F.lit(6), F.length("tag")), F.struct("line_no", "place")).alias("v"))
    return last.select(F.coalesce("v", F.lit(DEFAULT_VERSION)).alias("version"))


def segments(gfa: DataFrame) -> DataFrame:
    """S lines with at least three fields: (line_no, name, key, sequence, valid, symbol)."""
    s = records(gfa, "S").where(F.size("fields") >= 3)
    s = s.select("line_no", F.get("fields", F.lit(1)).alias("name"), F.get("fields", F.lit(2)).alias("sequence"))
    starred = F.col("sequence") == "*"
    return s.select("line_no", "name", segment_key(F.col("name")).alias("key"), "sequence", (~starred & is_valid(F.col("sequence"))).alias("valid"), F.when(~starred, invalid_symbol(F.col("sequence"))).alias("symbol"))


def paths(gfa: DataFrame) -> DataFrame:
    """P lines with at least four fields: (line_no, identifier, steps or null, overlaps, blunt)."""
    p = records(gfa, "P").where(F.size("fields") >= 4)
    p = p.select("line_no", F.get("fields", F.lit(1)).alias("identifier"), path_steps(F.get("fields", F.lit(2))).alias("steps"), F.get("fields", F.lit(3)).alias("overlaps"))
    none = F.array().cast("array<struct<segment:string,orientation:string>>")
    return p.withColumn("blunt", blunt(F.col("overlaps"), F.coalesce("steps", none)))


def walks(gfa: DataFrame) -> DataFrame:
    """W lines with at least seven fields: (line_no, identifier, haplotype, steps or null, start, end, unbounded, ranged)."""
    w = records(gfa, "W").where(F.size("fields") >= 7)
    f = lambda k: F.get("fields", F.lit(k))
    w = w.select("line_no", F.concat_ws("#", f(1), f(2), f(3)).alias("identifier"), f(2).alias("haplotype"), walk_steps(f(6)).alias("steps"), number(f(4)).alias("s"), number(f(5)).alias("e"), ((f(4) == "*") & (f(5) == "*")).alias("unbounded"))
    ranged = F.coalesce(F.col("s") < F.col("e"), F.lit(False)) & ~F.col("unbounded")
    return w.select("line_no", "identifier", "haplotype", "steps", F.when(ranged, F.col("s")).alias("start"), F.when(ranged, F.col("e")).alias("end"), "unbounded", ranged.alias("ranged"))


def traversals(gfa: DataFrame) -> DataFrame:
    """P and W records together: (line_no, identifier, record_type, start, end, steps); malformed steps are none."""
    none = F.array().cast("array<struct<segment:string,orientation:string>>")
    wide = "decimal(21,0)"
    p = paths(gfa).select("line_no", "identifier", F.lit("P").alias("record_type"), F.lit(None).cast(wide).alias("start"), F.lit(None).cast(wide).alias("end"), F.coalesce("steps", none).alias("steps"))
    w = walks(gfa).select("line_no", "identifier", F.lit("W").alias("record_type"), F.col("start").cast(wide).alias("start"), F.col("end").cast(wide).alias("end"), F.coalesce("steps", none).alias("steps"))
    return p.union(w)
