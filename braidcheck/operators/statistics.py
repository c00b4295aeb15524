"""Comprehensive statistics of outcomes, and their aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import ambiguous_bases
from ..schemas import BASE_PARTS, STATUSES
from .align import align, ambiguous

FIELDS = ["source_ambiguous_bases", "ambiguous_columns", "length_delta", *BASE_PARTS, "edit_distance", "alignment_status"]


_SUMS = ["matched", "substituted", "source_only", "graph_only", "ambiguous_columns"]
_ALIGNED = ", ".join(["ok boolean", *[f"{n} long" for n in _SUMS], "graph_ambiguous long"])


def _alignments(max_cells: int):
    """Function of a sequence and its parts: the sums of the alignments of the records, which share the cells; null for null."""

    @F.arrow_udf("struct<" + _ALIGNED.replace(" ", ":").replace(",:", ",") + ">")
    def run(sequences: pa.Array, parts: pa.Array) -> pa.Array:
        parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
        flat = parts.flatten()
        starts, ends, graphs = (flat.field(n).to_pylist() for n in ("start", "end", "graph"))
        counts = pc.fill_null(pc.list_value_length(parts), 0).to_pylist()
        out, at = [], 0
        for sequence, count in zip(sequences.to_pylist(), counts):
            if sequence is None:
                out.append(None)
                at += count
                continue
            left, sums, odd, ok = max_cells, [0] * 5, 0, True
            for k in range(at, at + count):
                graph, start, end = graphs[k], starts[k], ends[k]
                odd += ambiguous(graph)
                got = align(sequence if start is None or end is None else sequence[start:end], graph, left)
                if got is None:
                    ok = False
                    break
                left -= got.cells
                sums = [s + x for s, x in zip(sums, (got.matched, got.substituted, got.source_only, got.graph_only, got.ambiguous_columns))]
            at += count
            out.append((ok, *(sums if ok else [0] * 5), odd))
        given = np.array([x is not None for x in out], dtype=bool)
        columns = [[x[i] if x else None for x in out] for i in range(7)]
        arrays = [pa.array(c, pa.bool_() if i == 0 else pa.int64()) for i, c in enumerate(columns)]
        return pa.StructArray.from_arrays(arrays, ["ok", *_SUMS, "graph_ambiguous"], mask=pa.array(~given))

    return run


def add_statistics(rows: DataFrame, memory_bytes: int, max_cells: int) -> DataFrame:
    """Rows of outcomes() with the statistics fields. Only texts of divergent rows within the memory limit go through Python."""
    size = F.col("source_length") + F.col("graph_length")
    divergent = F.col("status") == "DIVERGENT"
    aligned = divergent & (size <= memory_bytes)
    rows = rows.withColumn("a", _alignments(max_cells)(F.when(aligned, F.col("sequence")), F.when(aligned, F.col("parts"))))
    identical, no_path, no_source = (F.col("status") == s for s in ("IDENTICAL", "MISSING_PATH", "MISSING_SOURCE"))
    done = divergent & F.coalesce(F.col("a.ok"), F.lit(False))
    over = divergent & ~done

    def when(*cases: tuple[Column, Column]) -> Column:
        out = F
        for condition, value in cases:
            out = out.when(condition, value)
        return out.otherwise(0).cast("long")

    graph_odd = F.when(over & F.col("a").isNotNull(), F.col("a.graph_ambiguous")).otherwise(F.col("graph_ambiguous_bases"))
    both = identical | divergent
    return rows.withColumns(
        {
            "source_ambiguous_bases": when((F.col("source_index").isNotNull(), ambiguous_bases(F.col("sequence")))),
            "ambiguous_columns": when((identical, F.col("graph_ambiguous_bases")), (done, F.col("a.ambiguous_columns"))),
            "length_delta": F.when(both, F.col("graph_length") - F.col("addressed_source_bases")),
            "matched": when((identical, F.col("graph_length")), (done, F.col("a.matched"))),
            "substituted": when((done, F.col("a.substituted"))),
            "source_only": when((done, F.col("a.source_only"))),
            "graph_only": when((done, F.col("a.graph_only"))),
            "not_embedded": when((both, F.col("source_length") - F.col("addressed_source_bases"))),
            "missing_path_bases": when((no_path, F.col("source_length"))),
            "missing_source_bases": when((no_source, F.col("graph_length"))),
            "unaligned_divergent_source": when((over, F.col("addressed_source_bases"))),
            "unaligned_divergent_graph": when((over, F.col("graph_length"))),
            "edit_distance": F.when(identical, F.lit(0)).when(done, F.col("a.substituted") + F.col("a.source_only") + F.col("a.graph_only")).cast("long"),
            "alignment_status": F.when(identical, "not_required").when(done, "complete").when(over & (size > memory_bytes), "memory_limit_exceeded").when(over, "limit_exceeded").otherwise("not_applicable"),
            "graph_ambiguous_bases": graph_odd,
        }
    ).drop("a")


def without_statistics(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f: F.lit(None).cast("string" if f == "alignment_status" else "long") for f in FIELDS})


def aggregate_columns() -> list[Column]:
    """The counters of an aggregate over outcomes with statistics."""
    has = F.col("source_index").isNotNull()
    graph = F.coalesce("graph_length", F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    done = F.col("edit_distance").isNotNull()
    columns = F.col("matched") + F.col("substituted") + F.col("source_only") + F.col("graph_only")
    return [
        F.count_if(has).alias("source_sequences"),
        F.count_if((graph > 0) | ~has).alias("graph_traversals"),
        total(F.when(has, F.col("source_length"))).alias("source_bases"),
        total(graph).alias("graph_bases"),
        total("source_ambiguous_bases").alias("source_ambiguous_bases"),
        total("graph_ambiguous_bases").alias("graph_ambiguous_bases"),
        total("ambiguous_columns").alias("ambiguous_columns"),
        total("edit_distance").alias("edit_distance"),
        total(F.when(done, columns)).alias("aligned_columns"),
        F.count_if(F.col("alignment_status") == "complete").alias("completed_alignments"),
        F.count_if(F.col("alignment_status").isin("limit_exceeded", "memory_limit_exceeded")).alias("unavailable_alignments"),
        *[total(p).alias(p) for p in BASE_PARTS],
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES],
    ]


def aggregates(outcomes: DataFrame) -> DataFrame:
    """Aggregates of everything, of each source and of each record type, as rows (source_index, record_type, level)."""
    # Sums of each source and type first, so that what is summed three times is a few rows.
    sums = outcomes.groupBy("source_index", "record_type").agg(*aggregate_columns())
    level = F.grouping_id().alias("level")
    sets = [[], [F.col("source_index")], [F.col("record_type")]]
    names = [c for c in sums.columns if c not in ("source_index", "record_type")]
    rows = sums.groupingSets(sets, "source_index", "record_type").agg(level, *[F.sum(c).cast("long").alias(c) for c in names])
    # level: 3 all, 1 by source, 2 by record type; rows without a source or a record belong to no group of theirs.
    return rows.where("level = 3 or (level = 1 and source_index is not null) or (level = 2 and record_type is not null)")


def summary_counts(outcomes: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]
    return outcomes.agg(*counts, F.count(F.lit(1)).alias("total"))
