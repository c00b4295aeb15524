"""The audit as a function, and its result."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .args import Arguments, Source, arguments
from .errors import ArgumentError, AuditError, InputError, OperationalError, diagnostic
from .functions.digests import blake3
from .functions.sequences import mapped_identifier, sha256
from .operators import compare, statistics
from .plans import preflight
from .schemas import BASE_PARTS, DIAGNOSTICS, OUTCOME_COLUMNS, OUTCOMES, STATUSES
from .sources import gfa as G
from .sources.fasta import frame_fasta, read_fasta
from .sources.lines import probe

#: Version of the contract that outcomes and diagnostics follow.
CONTRACT_VERSION = "0.1.2"
#: Diagnostics that an error holds itself; the frame has the rest as well.
MOST_DIAGNOSTICS = 10_000
_COUNTERS = ["source_sequences", "graph_traversals", "source_bases", "graph_bases", "source_ambiguous_bases", "graph_ambiguous_bases", "ambiguous_columns", "edit_distance", "aligned_columns", "completed_alignments", "unavailable_alignments"]


@dataclass
class AuditResult:
    """Outcomes (a DataFrame in the order of identifiers) and what belongs to them."""

    outcomes: DataFrame
    summary: dict[str, Any]
    statistics: dict[str, Any]
    provenance: dict[str, Any]
    telemetry: dict[str, Any]
    held: list[DataFrame] = field(default_factory=list, repr=False)

    def __post_init__(self) -> None:
        missing = {"identifier", "source_index", "status", "record_type"} - set(self.outcomes.columns)
        if missing:
            raise ValueError(f"outcomes lack {sorted(missing)}")

    def __repr__(self) -> str:
        c = self.summary["counts"]
        return "\n".join(
            [
                "AuditResult",
                f"  identical: {c['identical']}  divergent: {c['divergent']}",
                f"  missing path: {c['missing_path']}  missing source: {c['missing_source']}",
                "  topology validated: no",
            ]
        )

    def show(self) -> None:
        print(self)

    def summarise(self) -> dict[str, Any]:
        return {**self.summary, "statistics": self.statistics}

    def to_pandas(self):
        return self.outcomes.toPandas()

    def close(self) -> None:
        """Free what the outcomes are kept in; they are made anew if used again."""
        for df in self.held:
            df.unpersist()


def _checked(x: Any) -> AuditResult:
    if not isinstance(x, AuditResult):
        raise ArgumentError(f"x must be an AuditResult (from audit_gfa()), not {type(x).__name__}")
    return x


def audit_outcomes(x: AuditResult) -> DataFrame:
    return _checked(x).outcomes


def audit_summary(x: AuditResult) -> dict[str, Any]:
    return _checked(x).summary


def audit_statistics(x: AuditResult) -> dict[str, Any]:
    return _checked(x).statistics


def audit_provenance(x: AuditResult) -> dict[str, Any]:
    return _checked(x).provenance


def audit_telemetry(x: AuditResult) -> dict[str, Any]:
    return _checked(x).telemetry


def diagnostics_frame(spark: SparkSession, error: AuditError) -> DataFrame:
    """All diagnostics of an error, in order; read anew from the inputs where they are more than it holds."""
    if error.frame is not None:
        return error.frame
    columns = [c.split(" ")[0] for c in DIAGNOSTICS.split(", ")]
    return spark.createDataFrame([tuple(d[c] for c in columns) for d in error.diagnostics], DIAGNOSTICS)


def _source_frames(spark: SparkSession, source: Source, index: int) -> tuple[DataFrame, DataFrame]:
    records, errors = read_fasta(spark, source.path) if source.path else frame_fasta(spark, source.frame)
    lit = F.lit
    identifier = mapped_identifier(F.col("raw_name"), lit(source.mode), lit(source.sample), lit(source.haplotype), lit(source.prefix))
    records = records.select(lit(index).cast("long").alias("source_index"), "record_no", "raw_name", identifier.alias("identifier"), "sequence", lit(source.label).alias("label"))
    return records, errors.select(lit(index).cast("long").alias("source_index"), lit(source.label).alias("label"), "message")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def add_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 and BLAKE3 of source, addressed source and graph; a text that equals one already digested is not digested again."""
    whole = F.col("addressed") == F.col("sequence")
    same = F.upper("graph") == F.upper("addressed")
    rows = rows.withColumn("source_sha256", sha256(F.col("sequence")))
    rows = rows.withColumn("addressed_source_sha256", F.when(F.col("addressed").isNull(), None).when(whole, F.col("source_sha256")).otherwise(sha256(F.col("addressed"))))
    rows = rows.withColumn("graph_sha256", F.when(F.coalesce(same, F.lit(False)), F.col("addressed_source_sha256")).otherwise(sha256(F.col("graph"))))
    rows = rows.withColumns(
        {
            "_s": blake3(F.col("sequence")),
            "_a": blake3(F.when(F.coalesce(whole, F.lit(False)), None).otherwise(F.col("addressed"))),
            "_g": blake3(F.when(F.coalesce(same, F.lit(False)), None).otherwise(F.col("graph"))),
        }
    )
    rows = rows.withColumn("source_blake3", F.col("_s")).withColumn("addressed_source_blake3", F.when(F.col("addressed").isNull(), None).otherwise(F.coalesce("_a", "_s")))
    return rows.withColumn("graph_blake3", F.when(F.col("graph").isNull(), None).otherwise(F.coalesce("_g", "addressed_source_blake3"))).drop("_s", "_a", "_g")


def _aggregate_view(row: dict[str, Any]) -> dict[str, Any]:
    return {**{k: row[k] for k in _COUNTERS}, "bases": {k: row[k] for k in BASE_PARTS}, "statuses": {s.lower(): row[s.lower()] for s in STATUSES}}


def _statistics_view(outcomes: DataFrame, sources: int) -> dict[str, Any]:
    rows = [r.asDict() for r in statistics.aggregates(outcomes).collect()]
    empty = {k: 0 for k in [*_COUNTERS, *BASE_PARTS, *[s.lower() for s in STATUSES]]}
    by_source = {r["source_index"]: r for r in rows if r["level"] == 1}
    return {
        "global": _aggregate_view(next((r for r in rows if r["level"] == 3), empty)),
        "by_source": [_aggregate_view(by_source.get(i + 1, empty)) for i in range(sources)],
        "by_record_type": {r["record_type"]: _aggregate_view(r) for r in sorted((r for r in rows if r["level"] == 2), key=lambda r: r["record_type"])},
    }


def _raise(rows: list[dict], frame: DataFrame | None = None) -> None:
    kind = OperationalError if any(r["category"] in ("operational", "internal") for r in rows) else InputError
    raise kind(rows[0]["message"] if rows else "audit failed", rows, frame)


def _failure(error: Exception) -> OperationalError:
    """What Spark failed of: memory, room for what it spills and shuffles, or else."""
    text = str(error)
    # An error out of the JVM names the call in its first line and the cause in the next.
    told = next((t[2:] for t in text.splitlines() if t.startswith(": ")), text.split("\n")[0]) or type(error).__name__
    if "OutOfMemoryError" in text or "ExecutorLostFailure" in text and "memory" in text.lower() or isinstance(error, MemoryError):
        code, message = "OUT_OF_MEMORY", "memory allocation failed"
    elif "No space left on device" in text or "DiskErrorException" in text:
        code, message = "TEMP_STORE", told
    else:
        code, message = "AUDIT_FAILED", told
    return OperationalError(message, [diagnostic("operational", code, message)])


def _read(spark: SparkSession, args: Arguments, held: list[DataFrame]):
    """Parsed inputs, diagnostics in order (the first MOST_DIAGNOSTICS of the rows found by Spark), and a frame of all where they are more."""
    early: list[tuple[list[int], str, dict]] = []
    compressions, fastas, errors = [], [], []
    for i, source in enumerate(args.sources, 1):
        try:
            compressions.append(probe(spark, source.path)[0] if source.path else "plain")
        except OSError as error:
            compressions.append("")
            early.append(([0, i, -1, 0], "", diagnostic("source", "FASTA_READ", str(error), path=source.label)))
            continue
        records, problems = _source_frames(spark, source, i)
        fastas.append(records)
        errors.append(problems)
    checks: list[DataFrame] = []
    fasta = None
    if fastas:
        fasta = _union(fastas).persist()
        held.append(fasta)
        checks += preflight.source_rows(fasta, _union(errors))
        lengths = fasta.groupBy("identifier").agg(F.min_by(F.length("sequence"), F.struct("source_index", "record_no")).cast("long").alias("source_length"))
    else:
        lengths = spark.createDataFrame([], "identifier string, source_length long")
    gfa, gfa_kind = None, ""
    try:
        gfa_kind = probe(spark, args.gfa)[0]
        gfa = G.read_gfa(spark, args.gfa).persist()
        held.append(gfa)
        broken = gfa.where("error is not null").select("error").first()
        if broken:
            raise OSError(broken["error"])
        checks += preflight.graph_rows(gfa, lengths, args.gfa)
    except OSError as error:
        early.append(([1, -1, 0, 0], "", diagnostic("gfa", "GFA_READ", str(error), path=args.gfa)))
    found, frame = list(early), None
    if checks:
        made = _union(checks)
        rows = made.orderBy("order", "tie").limit(MOST_DIAGNOSTICS + 1).collect()
        if len(rows) > MOST_DIAGNOSTICS:
            first = [(order, tie, *(d[c] for c in made.columns[2:])) for order, tie, d in early]
            frame = made.union(spark.createDataFrame(first, made.schema)).orderBy("order", "tie").drop("order", "tie")
        for r in rows[:MOST_DIAGNOSTICS]:
            row = r.asDict()
            found.append((row.pop("order"), row.pop("tie"), {**row, "details": dict(row["details"] or {})}))
    found.sort(key=lambda x: (x[0], x[1]))
    return fasta, gfa, gfa_kind, compressions, [x[2] for x in found], frame


def audit_gfa(
    spark: SparkSession,
    fasta: Any,
    gfa: str,
    mapping: Any = None,
    statistics: str = "basic",  # noqa: F811
    threads: int = 1,
    memory_mib: int = 1024,
    alignment_max_cells: int = 10_000_000,
) -> AuditResult:
    """Compare source sequences with the traversals of a graph that claim to embed them.

    fasta: a path, sequences in memory (a DataFrame (name, sequence), a dict or pairs), or a list or dict of these.
    gfa: a path. mapping: a row per source with mode exact, pansn (sample, haplotype) or prefix (prefix).
    statistics "comprehensive" aligns divergent traversals within memory_mib and alignment_max_cells.
    threads is kept as provenance; results do not depend on it.

    Letters are compared literally, case aside. A source that ends first gives a BASE divergence at the
    segment there; an unbounded walk that spells the beginning of its source is IDENTICAL; two ranges of
    one walk with wrong lengths are not RANGE_LENGTH unless the last is the first divergence.

    Raises ArgumentError, InputError or OperationalError with diagnostics.
    """
    args = arguments(fasta, gfa, mapping, statistics, threads, memory_mib, alignment_max_cells)
    tag = f"audit-{uuid.uuid4().hex}"
    held: list[DataFrame] = []
    spark.addTag(tag)
    try:
        return _audit(spark, args, held)
    except AuditError:
        _drop(held)
        raise
    except KeyboardInterrupt:
        spark.interruptTag(tag)
        _drop(held)
        raise
    except (PySparkException, Py4JError, MemoryError) as error:
        _drop(held)
        raise _failure(error) from error
    except Exception as error:
        _drop(held)
        raise OperationalError(str(error), [diagnostic("internal", "INTERNAL_ERROR", str(error))]) from error
    finally:
        spark.removeTag(tag)


def _drop(held: list[DataFrame]) -> None:
    for df in held:
        df.unpersist()


def _audit(spark: SparkSession, args: Arguments, held: list[DataFrame]) -> AuditResult:
    sources, gfa, gfa_kind, compressions, problems, frame = _read(spark, args, held)
    if problems:
        _raise(problems, frame)
    rows = compare.outcomes(sources.select("identifier", "source_index", "sequence"), G.traversals(gfa), G.segments(gfa))
    limit = args.memory_mib * 1024**2
    comprehensive = args.statistics == "comprehensive"
    rows = statistics.add_statistics(rows, limit, args.alignment_max_cells) if comprehensive else statistics.without_statistics(rows)
    kinds = dict(OUTCOMES)
    # Kept before they are sorted: the sort samples its input first and would digest all sequences twice.
    outcomes = add_digests(rows).select(*[F.col(c).cast(kinds[c]).alias(c) for c in OUTCOME_COLUMNS]).persist()
    held.append(outcomes)

    aligned = F.col("alignment_status").isin("complete", "limit_exceeded")
    facts = outcomes.agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES],
        F.coalesce(F.greatest(F.max("source_length"), F.max(F.when(aligned, F.col("source_length") + F.col("graph_length")))), F.lit(0)).alias("peak"),
        F.count_if(F.col("source_length") > limit).alias("oversized"),
    ).first()
    counts = {s.lower(): facts[s.lower()] for s in STATUSES}
    total = sum(counts.values())
    graph = gfa.agg(
        F.count_if((F.get("fields", F.lit(0)) == "P") & (F.size("fields") >= 4)).alias("p"),
        F.count_if((F.get("fields", F.lit(0)) == "W") & (F.size("fields") >= 7)).alias("w"),
        F.coalesce(F.bool_or((F.get("fields", F.lit(0)) == "P") & (F.get("fields", F.lit(3)) == "*")), F.lit(False)).alias("starred"),
    ).first()
    return AuditResult(
        outcomes.orderBy("identifier"),
        {"counts": counts, "percentages": {k: 100 * v / total if total else None for k, v in counts.items()}, "total": total},
        _statistics_view(outcomes, len(args.sources)) if comprehensive else {},
        {
            "package_version": __version__,
            "reference_version": CONTRACT_VERSION,
            "fasta": [s.label for s in args.sources],
            "gfa": args.gfa,
            "mapping": args.mapping,
            "statistics": args.statistics,
            "threads": args.threads,
            "memory_mib": args.memory_mib,
            "alignment_max_cells": args.alignment_max_cells,
            "topology_validated": False,
            "fasta_compressions": compressions,
            "gfa_version": G.header_version(gfa).first()["version"],
            "gfa_compression": gfa_kind,
            "path_records": graph["p"],
            "walk_records": graph["w"],
            "unspecified_overlaps_as_blunt": graph["starred"],
        },
        {"limit_bytes": limit, "peak_tracked_bytes": facts["peak"], "oversized_contigs": facts["oversized"], "threads": args.threads},
        held,
    )
