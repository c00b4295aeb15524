"""All rules that the inputs must keep. Each broken rule is a row; any row stops the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequences import invalid_position, invalid_symbol, number, segment_key
from ..sources import gfa as G

# Category and message of each code.
RULES = {
    "FASTA_READ": ("source", "cannot open input"),
    "INVALID_FASTA": ("source", None),
    "INVALID_SOURCE_NUCLEOTIDE": ("source", "invalid source nucleotide"),
    "DUPLICATE_SEQUENCE_IDENTIFIER": ("source", "duplicate sequence identifier"),
    "DUPLICATE_SEGMENT": ("gfa", "duplicate segment"),
    "SEQUENCELESS_SEGMENT": ("gfa", "segment has no sequence"),
    "INVALID_NUCLEOTIDE": ("gfa", "invalid segment nucleotide"),
    "MALFORMED_S_RECORD": ("gfa", "segment record has too few fields"),
    "DUPLICATE_PATH": ("correspondence", "duplicate path identifier"),
    "MALFORMED_PATH": ("gfa", "malformed path traversal"),
    "UNSUPPORTED_OVERLAP": ("gfa", "only blunt path overlaps are supported"),
    "MALFORMED_P_RECORD": ("gfa", "path record has too few fields"),
    "INVALID_HAPLOTYPE": ("gfa", "walk haplotype is not numeric"),
    "MALFORMED_WALK": ("gfa", "malformed walk traversal"),
    "W_RANGE_OUT_OF_BOUNDS": ("correspondence", "walk range exceeds source sequence"),
    "INVALID_W_RANGE": ("gfa", "invalid walk range"),
    "MALFORMED_W_RECORD": ("gfa", "walk record has too few fields"),
    "DUPLICATE_EMBEDDED_PATH": ("correspondence", "identifier is claimed by a path and a walk"),
    "AMBIGUOUS_W_RANGES": ("correspondence", "multiple walks use unspecified ranges"),
    "W_RANGE_OVERLAP": ("correspondence", "walk ranges overlap"),
    "UNRESOLVED_SEGMENT": ("gfa", "traversal references an unknown segment"),
    "GFA_READ": ("gfa", "cannot open input"),
}


def duplicate_sources(fasta: DataFrame) -> DataFrame:
    """Rows of fasta (identifier, source_index, record_no, ...) whose identifier an earlier one has."""
    w = Window.partitionBy("identifier").orderBy("source_index", "record_no")
    return fasta.withColumn("_k", F.row_number().over(w)).where("_k > 1").drop("_k")


def duplicate_segments(segments: DataFrame) -> DataFrame:
    """Segments whose name an earlier valid one has, numbers being equal however written."""
    first = segments.where("valid").groupBy("key").agg(F.min("line_no").alias("_first"))
    return segments.join(first, "key").where("line_no > _first").drop("_first")


def duplicate_paths(paths: DataFrame) -> DataFrame:
    w = Window.partitionBy("identifier").orderBy("line_no")
    return paths.withColumn("_k", F.row_number().over(w)).where("_k > 1").drop("_k")


def path_walk_conflicts(paths: DataFrame, walks: DataFrame) -> DataFrame:
    return paths.select("identifier").intersect(walks.select("identifier"))


def ambiguous_ranges(walks: DataFrame) -> DataFrame:
    return walks.groupBy("identifier").agg(F.count(F.lit(1)).alias("n"), F.bool_or("unbounded").alias("any_unbounded")).where("n > 1 and any_unbounded").select("identifier")


def overlapping_ranges(walks: DataFrame) -> DataFrame:
    """A row for each range that begins before the one before it, by start and end, ends."""
    w = Window.partitionBy("identifier").orderBy("start", "end", "line_no")
    ranked = walks.where("ranged").withColumns({"_k": F.row_number().over(w), "_before": F.lag("end").over(w)})
    return ranked.where("start < _before").select("identifier", "start", "end", F.col("_before").alias("previous_end"), F.col("_k").alias("k"))


def ranges_out_of_bounds(walks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Ranged walks that end after their source (identifier, source_length)."""
    return walks.where("ranged").join(lengths, "identifier").where(F.col("end") > F.col("source_length"))


def unresolved_segments(traversals: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment, identifier) of steps without a valid segment before their line and without one of the same written name after it."""
    steps = traversals.select("line_no", "identifier", F.explode("steps").alias("s")).select("line_no", "identifier", F.col("s.segment").alias("segment"))
    steps = steps.groupBy("identifier", "segment", "line_no").agg(F.lit(1).alias("_one")).withColumn("key", segment_key(F.col("segment")))
    before = segments.where("valid").groupBy("key").agg(F.min("line_no").alias("_valid"))
    after = segments.groupBy(F.col("name").alias("segment")).agg(F.max("line_no").alias("_last"))
    found = steps.join(before, "key", "left").join(after, "segment", "left")
    known = F.coalesce(F.col("_valid") < F.col("line_no"), F.lit(False)) | F.coalesce(F.col("_last") > F.col("line_no"), F.lit(False))
    return found.where(~known).select("segment", "identifier").distinct()


def _rows(df: DataFrame, code: str, order: list[Column], line=None, identifier=None, position=None, symbol=None, details=None, path=None, message=None) -> DataFrame:
    category, text = RULES[code]
    none = lambda kind: F.lit(None).cast(kind)
    return df.select(
        F.array(*[o.cast("long") for o in order]).alias("order"),
        F.coalesce(identifier, F.lit("")).alias("tie") if identifier is not None else F.lit("").alias("tie"),
        F.lit(category).alias("category"),
        F.lit(code).alias("code"),
        (message if message is not None else F.lit(text)).alias("message"),
        (path if path is not None else none("string")).alias("path"),
        (line.cast("double") if line is not None else none("double")).alias("line"),
        (identifier if identifier is not None else none("string")).alias("identifier"),
        (position.cast("double") if position is not None else none("double")).alias("position"),
        (symbol if symbol is not None else none("string")).alias("symbol"),
        (F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]) if details else F.create_map().cast("map<string,string>")).alias("details"),
    )


def source_rows(fasta: DataFrame, errors: DataFrame) -> list[DataFrame]:
    """Rows about fasta (source_index, record_no, label, identifier, sequence) and errors (source_index, label, message)."""
    i, r = F.col("source_index"), F.col("record_no")
    bad = fasta.withColumns({"p": invalid_position(F.col("sequence")), "s": invalid_symbol(F.col("sequence"))}).where("p is not null")
    return [
        _rows(bad, "INVALID_SOURCE_NUCLEOTIDE", [F.lit(0), i, r, F.lit(0)], identifier=F.col("identifier"), position=F.col("p"), symbol=F.col("s"), path=F.col("label")),
        _rows(duplicate_sources(fasta), "DUPLICATE_SEQUENCE_IDENTIFIER", [F.lit(0), i, r, F.lit(1)], identifier=F.col("identifier"), path=F.col("label")),
        _rows(errors, "INVALID_FASTA", [F.lit(0), i, F.lit(2**62), F.lit(2)], path=F.col("label"), message=F.col("message")),
    ]


def graph_rows(gfa: DataFrame, lengths: DataFrame, path: str) -> list[DataFrame]:
    """Rows about gfa (line_no, fields), with lengths (identifier, source_length) of the sources."""
    where, line, name = F.lit(path), F.col("line_no"), F.col("identifier")
    s, p, w = G.segments(gfa), G.paths(gfa), G.walks(gfa)

    def at(seq: int) -> list[Column]:
        return [F.lit(1), line, F.lit(seq), F.lit(0)]

    def post(step: int, k: Column | None = None) -> list[Column]:
        return [F.lit(2), F.lit(step), k if k is not None else F.lit(0), F.lit(0)]

    rows = [
        _rows(duplicate_segments(s), "DUPLICATE_SEGMENT", at(0), line=line, identifier=F.col("name"), path=where),
        _rows(s.where("sequence = '*'"), "SEQUENCELESS_SEGMENT", at(1), line=line, identifier=F.col("name"), path=where),
        _rows(s.where("symbol is not null"), "INVALID_NUCLEOTIDE", at(1), line=line, symbol=F.col("symbol"), path=where),
        _rows(duplicate_paths(p), "DUPLICATE_PATH", at(0), line=line, identifier=name, path=where),
        _rows(p.where("steps is null"), "MALFORMED_PATH", at(1), line=line, path=where),
        _rows(p.where("not blunt"), "UNSUPPORTED_OVERLAP", at(2), line=line, details={"overlap": F.col("overlaps")}, path=where),
        _rows(w.where(number(F.col("haplotype")).isNull()), "INVALID_HAPLOTYPE", at(0), line=line, details={"value": F.col("haplotype")}, path=where),
        _rows(w.where("steps is null"), "MALFORMED_WALK", at(1), line=line, path=where),
        _rows(ranges_out_of_bounds(w, lengths), "W_RANGE_OUT_OF_BOUNDS", at(2), line=line, identifier=name, details={"end": F.col("end"), "source_length": F.col("source_length")}, path=where),
        _rows(w.where("not unbounded and not ranged"), "INVALID_W_RANGE", at(2), line=line, path=where),
        _rows(path_walk_conflicts(p, w), "DUPLICATE_EMBEDDED_PATH", post(0), identifier=name, path=where),
        _rows(ambiguous_ranges(w), "AMBIGUOUS_W_RANGES", post(1), identifier=name, path=where),
        _rows(overlapping_ranges(w), "W_RANGE_OVERLAP", post(2), identifier=name, path=where),
    ]
    for kind, least in (("S", 3), ("P", 4), ("W", 7)):
        rows.append(_rows(G.records(gfa, kind).where(F.size("fields") < least), f"MALFORMED_{kind}_RECORD", at(0), line=line, path=where))
    missing = _rows(unresolved_segments(G.traversals(gfa), s).withColumn("line_no", F.lit(0)), "UNRESOLVED_SEGMENT", post(3), identifier=name, details={"segment": F.col("segment")}, path=where)
    rows.append(missing.withColumn("tie", F.concat_ws("\u0001", F.col("details")["segment"], "tie")))
    return rows
