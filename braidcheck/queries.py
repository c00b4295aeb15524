"""One query per operator over the bridge data, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bridge as B
from .functions import digests
from .functions import sequences as S
from .operators import compare, statistics
from .plans import preflight as R
from .sources import gfa as G
from .sources.fasta import parse_fasta

C = F.col


def _lines(spark, d):
    return G.fields_of(B.gfa_lines(spark, d))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return compare.outcomes(B.sources(spark, d), B.path_traversals(spark, d), B.keyed_segments(spark, d))


def _walk_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return compare.outcomes(B.walk_sources(spark, d), B.walk_traversals(spark, d), B.keyed_segments(spark, d))


def _long(*names: str) -> list:
    return [C(n).cast("long").alias(n) for n in names]


def _named_sources(spark, d):
    c = B.table(spark, d, "customer")
    return c.select(F.concat(F.lit("n"), C("c_nationkey"), F.lit("-"), C("c_custkey") % 50).alias("identifier"), (C("c_custkey") % 3).cast("long").alias("source_index"), C("c_custkey").cast("long").alias("record_no"))


def _named_segments(spark, d):
    """Suppliers as segments whose names repeat, some with a leading zero, some invalid."""
    s = B.table(spark, d, "supplier")
    k = C("s_suppkey").cast("long")
    name = F.when(k % 2 == 1, F.concat(F.lit("0"), (k % 40).cast("string"))).otherwise((k % 40).cast("string"))
    return s.select(k.alias("line_no"), name.alias("name"), S.segment_key(name).alias("key"), (k % 3 != 0).alias("valid"))


def _named_traversals(spark, d):
    """Customers as traversals of two steps each, named like the suppliers' segments and beyond."""
    c = B.table(spark, d, "customer")
    k = C("c_custkey").cast("long")
    step = lambda x: F.struct(x.cast("string").alias("segment"), F.lit("+").alias("orientation"))
    return c.select((k % 60).alias("line_no"), F.concat(F.lit("c"), k % 100).alias("identifier"), F.array(step(k % 45), step(k % 37)).alias("steps"))


def _ranged_walks(spark, d):
    o = B.table(spark, d, "orders")
    k = C("o_orderkey").cast("long")
    start = (k * 37) % 1000
    return o.select(
        k.alias("line_no"), F.concat(F.lit("w"), C("o_custkey")).alias("identifier"), (k % 50 == 1).alias("unbounded"), (k % 50 != 1).alias("ranged"),
        start.cast("decimal(21,0)").alias("start"), (start + 20 + k % 60).cast("decimal(21,0)").alias("end"),
    )


def gfa_scan_records(spark, d):
    return _lines(spark, d).groupBy(F.get("fields", F.lit(0)).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("fields")).cast("long").alias("n_fields"))


def gfa_header_version(spark, d):
    return G.header_version(_lines(spark, d))


def segment_scan(spark, d):
    return G.segments(_lines(spark, d)).select("line_no", "name", "sequence", "valid")


def path_scan(spark, d):
    return G.paths(_lines(spark, d)).select("line_no", "identifier", F.when(C("steps").isNotNull(), F.size("steps")).cast("long").alias("n_steps"), "overlaps")


def walk_scan(spark, d):
    return G.walks(_lines(spark, d)).select("line_no", "identifier", F.when(C("steps").isNotNull(), F.size("steps")).cast("long").alias("n_steps"), "unbounded", "ranged")


def path_steps_parse(spark, d):
    p = G.paths(_lines(spark, d))
    return p.select("line_no", F.get("steps", F.lit(0))["segment"].alias("first_segment"), F.get("steps", F.lit(0))["orientation"].alias("first_orientation"), C("steps").isNull().alias("malformed"))


def walk_steps_parse(spark, d):
    w = G.walks(_lines(spark, d))
    return w.select("line_no", F.get("steps", F.lit(1))["segment"].alias("second_segment"), F.get("steps", F.lit(1))["orientation"].alias("second_orientation"), C("steps").isNull().alias("malformed"))


def iupac_validate(spark, d):
    return G.records(_lines(spark, d), "S").select("line_no", F.coalesce(S.is_valid(F.get("fields", F.lit(2))), F.lit(False)).alias("valid"))


def first_invalid_symbol(spark, d):
    s = G.records(_lines(spark, d), "S").where(F.size("fields") >= 3).select("line_no", F.get("fields", F.lit(2)).alias("q"))
    return s.select("line_no", S.invalid_position(C("q")).alias("position"), S.invalid_symbol(C("q")).alias("symbol")).where("position is not null")


def ambiguous_count(spark, d):
    return B.segments(spark, d).select("name", S.ambiguous_bases(C("sequence")).alias("ambiguous"))


def complement_iupac(spark, d):
    return B.segments(spark, d).select("name", S.complement(C("sequence")).alias("complement"))


def reverse_complement(spark, d):
    return B.segments(spark, d).select("name", S.oriented(C("sequence"), F.lit("-")).alias("reversed"))


def segment_position(spark, d):
    return B.oriented(spark, d).select("orderkey", "step_no", S.segment_position(C("orientation"), F.lit(2), F.length("bases")).alias("position"))


def _names(spark, d):
    k = C("c_custkey").cast("long")
    name = F.when(k % 4 == 0, F.concat(F.lit("00"), k)).when(k % 4 == 1, F.concat(k, F.lit("x"))).when(k % 4 == 2, F.concat(F.lit("18446744073709551"), (k % 1000 + 100).cast("string"))).otherwise(k.cast("string"))
    return B.table(spark, d, "customer").select(name.alias("name"))


def numeric_name(spark, d):
    return _names(spark, d).select("name", S.number(C("name")).cast("string").alias("number"))


def canonical_segment(spark, d):
    return _names(spark, d).select("name", S.segment_key(C("name")).alias("key"))


def identifier_mapping(spark, d):
    k = C("c_custkey").cast("long")
    mode = F.when(k % 3 == 0, "exact").when(k % 3 == 1, "pansn").otherwise("prefix")
    return B.table(spark, d, "customer").select(k.alias("custkey"), S.mapped_identifier(C("c_name"), mode, F.concat(F.lit("s"), C("c_nationkey")), F.lit("1"), F.lit("pre-")).alias("identifier"))


def overlap_blunt(spark, d):
    return G.paths(_lines(spark, d)).select("line_no", "blunt")


def sha256_sequence(spark, d):
    return B.segments(spark, d).select("name", S.sha256(F.lower("sequence")).alias("sha256"))


def blake3_sequence(spark, d):
    return B.segments(spark, d).select("name", digests.blake3(C("sequence")).alias("blake3"))


def dup_source_ids(spark, d):
    return R.duplicate_sources(_named_sources(spark, d))


def dup_segments(spark, d):
    return R.duplicate_segments(_named_segments(spark, d)).select("line_no", "name")


def dup_paths(spark, d):
    o = B.table(spark, d, "orders").select(C("o_orderkey").cast("long").alias("line_no"), F.concat(F.lit("p"), C("o_custkey")).alias("identifier"))
    return R.duplicate_paths(o)


def path_walk_conflict(spark, d):
    p = B.table(spark, d, "orders").select(F.concat(F.lit("i"), C("o_custkey")).alias("identifier"))
    w = B.table(spark, d, "customer").select(F.concat(F.lit("i"), C("c_custkey")).alias("identifier"))
    return R.path_walk_conflicts(p, w)


def ambiguous_walk_ranges(spark, d):
    return R.ambiguous_ranges(_ranged_walks(spark, d))


def walk_range_overlap(spark, d):
    return R.overlapping_ranges(_ranged_walks(spark, d)).select("identifier", *_long("start", "end", "previous_end", "k"))


def walk_range_bounds(spark, d):
    lengths = B.table(spark, d, "customer").select(F.concat(F.lit("w"), C("c_custkey")).alias("identifier"), (C("c_custkey") % 1000).cast("long").alias("source_length"))
    return R.ranges_out_of_bounds(_ranged_walks(spark, d), lengths).select("line_no", "identifier", *_long("end", "source_length"))


def unresolved_segments(spark, d):
    return R.unresolved_segments(_named_traversals(spark, d), _named_segments(spark, d))


def step_segment_join(spark, d):
    return B.oriented(spark, d)


def reconstruct_path(spark, d):
    g = B.graph_sequences(spark, d)
    return g.select("orderkey", F.length("graph").cast("long").alias("length"), S.sha256(C("graph")).alias("sha256"), S.ambiguous_bases(C("graph")).alias("ambiguous"))


def _walks(spark, d):
    return B.walk_records(spark, d)


def reconstruct_walk(spark, d):
    return _walk_outcomes(spark, d).select("identifier", F.length("graph").cast("long").alias("length"), S.sha256(C("graph")).alias("sha256"))


def source_range(spark, d):
    return _walk_outcomes(spark, d).select("identifier", C("source_start_0based").alias("range_start"), C("source_end_0based_exclusive").alias("range_end"))


def addressed_bases(spark, d):
    return _walk_outcomes(spark, d).select("identifier", C("addressed_source_bases").alias("addressed"))


def walk_outcomes(spark, d):
    return _walk_outcomes(spark, d).select("identifier", "status", "record_type", "divergence_kind", *_long("source_position_1based", "source_length", "graph_length", "range_length", "walk_length"))


def walk_addressed_digest(spark, d):
    return _walk_outcomes(spark, d).select("identifier", S.sha256(C("addressed")).alias("sha256"))


def walk_aggregates(spark, d):
    rows = statistics.aggregates(statistics.add_statistics(_walk_outcomes(spark, d), 1 << 30, 10_000_000))
    return rows.select(*_long("level", "source_index"), "record_type", "source_sequences", "graph_traversals", "source_bases", "graph_bases", "not_embedded", "identical", "divergent")


def fasta_scan(spark, d):
    records, _ = parse_fasta(B.fasta_lines(spark, d))
    return records.select("record_no", C("raw_name").alias("name"), "sequence")


def records_sorted(spark, d):
    return compare.ordered_records(B.walk_traversals(spark, d)).select("identifier", *_long("rec", "line_no", "start", "end"))


def addressed_digest(spark, d):
    o = _outcomes(spark, d)
    return o.where("addressed is not null").select("identifier", S.sha256(C("addressed")).alias("sha256"))


def missing_path(spark, d):
    return _outcomes(spark, d).where("status = 'MISSING_PATH'").select("identifier", "source_length")


def missing_source(spark, d):
    return _outcomes(spark, d).where("status = 'MISSING_SOURCE'").select("identifier", *_long("graph_length"))


def full_outcome_status(spark, d):
    return _outcomes(spark, d).select("identifier", "status", "source_length", *_long("graph_length"))


def step_offsets(spark, d):
    records = compare.ordered_records(B.path_traversals(spark, d))
    steps = compare.oriented_steps(records, B.keyed_segments(spark, d))
    lengths = B.sources(spark, d).select("identifier", F.length("sequence").cast("long").alias("source_length"))
    return compare.step_offsets(steps, lengths).select("identifier", *_long("step_no", "offset", "limit"))


def first_divergence(spark, d):
    return _outcomes(spark, d).where("status = 'DIVERGENT'").select("identifier", *_long("source_position_1based"))


def divergence_kind(spark, d):
    return _outcomes(spark, d).where("status = 'DIVERGENT'").select("identifier", "divergence_kind")


def range_length_mismatch(spark, d):
    w = _walks(spark, d)
    return w.where(C("end") - C("start") != C("n")).select("identifier", "start", (C("end") - C("start")).alias("range_length"), C("n").alias("walk_length"))


def _statistics(spark, d, memory=1 << 30, cells=10_000_000):
    return statistics.add_statistics(_outcomes(spark, d), memory, cells)


def edit_distance(spark, d):
    return _statistics(spark, d).where("status = 'DIVERGENT'").select("identifier", "edit_distance")


def alignment_limit(spark, d):
    return _statistics(spark, d, cells=4).where("status = 'DIVERGENT'").select("identifier", "alignment_status")


def memory_limit(spark, d):
    return _statistics(spark, d, memory=150).where("status = 'DIVERGENT'").select("identifier", "alignment_status", "unaligned_divergent_source")


def base_partition(spark, d):
    return _statistics(spark, d).select("identifier", "matched", "substituted", "source_only", "graph_only", "not_embedded", "missing_path_bases", "missing_source_bases")


def summary_counts(spark, d):
    return statistics.summary_counts(_outcomes(spark, d))


def percentages(spark, d):
    from pyspark.sql.window import Window

    # Four rows, so one window over all of them.
    o = _outcomes(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    return o.select("status", F.round(S.percentage(C("n"), C("total")), 6).alias("percentage"))


def aggregate_global_source_type(spark, d):
    return statistics.aggregates(_statistics(spark, d)).select(*_long("level", "source_index"), "record_type", "source_sequences", "graph_traversals", "source_bases", "graph_bases", "graph_ambiguous_bases", "edit_distance", "not_embedded", "missing_path_bases", "missing_source_bases", "identical", "divergent", "missing_path", "missing_source")


def record_counts(spark, d):
    g = _lines(spark, d)
    p, w = G.paths(g), G.walks(g)
    return p.agg(F.count(F.lit(1)).alias("path_records"), F.bool_or(C("overlaps") == "*").alias("starred")).join(F.broadcast(w.agg(F.count(F.lit(1)).alias("walk_records"))))


def walks_per_identifier(spark, d):
    return _walks(spark, d).groupBy("identifier").agg(F.count(F.lit(1)).alias("n"))


def distinct_names(spark, d):
    return G.traversals(_lines(spark, d)).select("record_type", "identifier").distinct().groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))


def union_sources(spark, d):
    a = B.table(spark, d, "customer").select(F.lit(1).cast("long").alias("source_index"), F.concat(F.lit("c"), C("c_custkey")).alias("identifier"))
    b = B.table(spark, d, "supplier").select(F.lit(2).cast("long").alias("source_index"), F.concat(F.lit("s"), C("s_suppkey")).alias("identifier"))
    return a.unionByName(b)


def outcomes_sorted(spark, d):
    return _outcomes(spark, d).select("identifier", "status").orderBy("identifier")


def chunked_range_join(spark, d):
    records = compare.ordered_records(B.path_traversals(spark, d))
    lengths = B.sources(spark, d).select("identifier", F.length("sequence").cast("long").alias("source_length"))
    offsets = compare.step_offsets(compare.oriented_steps(records, B.keyed_segments(spark, d)), lengths)
    p = compare.pieces(offsets).join(compare.chunks(B.sources(spark, d)), ["identifier", "chunk"])
    return p.select("identifier", *_long("step_no"), F.substring(C("text"), C("within") + 1, F.length("bases")).alias("there"))


def outcomes_with_digests(spark, d):
    from .api import add_digests

    return add_digests(_outcomes(spark, d)).select("identifier", "status", "source_sha256", "addressed_source_sha256", "graph_sha256", "source_blake3", "graph_blake3")


QUERIES = {
    f.__name__: f
    for f in (
        fasta_scan, gfa_scan_records, gfa_header_version, segment_scan, path_scan, walk_scan, path_steps_parse, walk_steps_parse, iupac_validate, first_invalid_symbol,
        ambiguous_count, complement_iupac, reverse_complement, segment_position, numeric_name, canonical_segment, identifier_mapping, overlap_blunt,
        sha256_sequence, blake3_sequence, dup_source_ids, dup_segments, dup_paths, path_walk_conflict, ambiguous_walk_ranges, walk_range_overlap,
        walk_range_bounds, unresolved_segments, step_segment_join, reconstruct_path, reconstruct_walk, source_range, addressed_bases, addressed_digest,
        missing_path, missing_source, full_outcome_status, step_offsets, first_divergence, divergence_kind, range_length_mismatch, edit_distance,
        alignment_limit, memory_limit, base_partition, summary_counts, percentages, aggregate_global_source_type, record_counts, walks_per_identifier,
        walk_outcomes, walk_addressed_digest, walk_aggregates, records_sorted, distinct_names, union_sources, outcomes_sorted, chunked_range_join, outcomes_with_digests,
    )
}

_BASE = f"""
seg AS (SELECT CAST(p_partkey AS BIGINT) AS line_no, CAST(p_partkey AS VARCHAR) AS name,
  substr(translate(md5(CAST(p_partkey AS VARCHAR)), '{B.DIGITS}', '{B.BASES}'), 1, CAST(8 + p_size % 25 AS BIGINT)) AS sequence FROM part),
st AS (SELECT CAST(l_orderkey AS BIGINT) AS orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS step_no,
  CAST(l_partkey AS VARCHAR) AS segment, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS orientation FROM lineitem),
ori AS (SELECT orderkey, step_no, segment, orientation,
  CASE WHEN orientation = '-' THEN translate(reverse(sequence), '{S.LETTERS}', '{S.COMPLEMENTS}') ELSE sequence END AS bases FROM st JOIN seg ON name = segment),
gr AS (SELECT orderkey, string_agg(bases, '' ORDER BY step_no) AS graph FROM ori GROUP BY orderkey),
srcall AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey % 3 + 1 AS BIGINT) AS source_index, graph AS g, length(graph) AS n, length(graph) // 2 AS h FROM orders LEFT JOIN gr ON orderkey = o_orderkey),
src AS (SELECT concat('o', k) AS identifier, source_index, CASE
  WHEN g IS NULL THEN translate(md5(CAST(k AS VARCHAR)), '{B.DIGITS}', '{B.BASES}')
  WHEN k % 10 = 0 THEN concat(substr(g, 1, h), CASE WHEN substr(g, h + 1, 1) = 'A' THEN 'C' ELSE 'A' END, substr(g, h + 2))
  WHEN k % 10 = 1 THEN substr(g, 1, n - 1) WHEN k % 10 = 2 THEN concat(g, 'A') WHEN k % 10 = 3 THEN concat(substr(g, 1, h), substr(g, h + 2)) ELSE g END AS sequence
  FROM srcall WHERE k % 10 <> 4),
pth AS (SELECT concat('o', orderkey) AS identifier, graph FROM gr),
cmp AS (SELECT coalesce(src.identifier, pth.identifier) AS identifier, source_index, sequence AS s, graph AS g,
  (SELECT min(i) FROM range(1, least(length(sequence), length(graph)) + 1) r(i) WHERE substr(sequence, i, 1) <> substr(graph, i, 1)) AS diff
  FROM src FULL JOIN pth ON src.identifier = pth.identifier),
oc AS (SELECT *, CASE WHEN s IS NULL THEN 'MISSING_SOURCE' WHEN g IS NULL THEN 'MISSING_PATH' WHEN s = g THEN 'IDENTICAL' ELSE 'DIVERGENT' END AS status,
  coalesce(diff, least(length(s), length(g)) + 1) AS pos, CASE WHEN diff IS NULL AND length(s) > length(g) THEN 'END' ELSE 'BASE' END AS kind FROM cmp),
wk AS (SELECT CAST(o_orderkey AS BIGINT) AS orderkey, concat('c', o_custkey, '#1#chr') AS identifier, graph, CAST(length(graph) AS BIGINT) AS n,
  coalesce(sum(length(graph) + 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ FROM orders JOIN gr ON orderkey = o_orderkey),
w AS (SELECT orderkey, identifier, graph, n, CAST(start_ AS BIGINT) AS start, CAST(start_ + n + CASE WHEN orderkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS "end" FROM wk)
"""
_WALKS = """
, ws0 AS (SELECT identifier, CAST(split_part(substr(identifier, 2), '#', 1) AS BIGINT) AS k, string_agg(concat(graph, 'AA'), '' ORDER BY start) AS s0, string_agg(graph, '' ORDER BY start) AS g,
  min(start + n) FILTER ("end" - start <> n) AS first_off, max(start + n) FILTER ("end" - start <> n) AS last_off, arg_max("end" - start, start) FILTER ("end" - start <> n) AS wanted, arg_max(n, start) FILTER ("end" - start <> n) AS held FROM w GROUP BY 1),
ws AS (SELECT *, CASE WHEN k % 10 = 0 THEN concat(CASE WHEN substr(s0, 1, 1) = 'A' THEN 'C' ELSE 'A' END, substr(s0, 2)) ELSE s0 END AS s, CASE WHEN k % 10 = 0 THEN 0 ELSE first_off END AS dv FROM ws0),
wo AS (SELECT *, CASE WHEN dv IS NULL THEN 'IDENTICAL' ELSE 'DIVERGENT' END AS status, CASE WHEN dv IS NULL THEN NULL WHEN dv = last_off THEN 'RANGE_LENGTH' WHEN k % 10 = 0 THEN 'BASE' ELSE 'END' END AS kind FROM ws)
"""
_LINES = """
, pt AS (SELECT orderkey, string_agg(concat(segment, orientation), ',' ORDER BY step_no) AS t, count(*) - 1 AS commas FROM st GROUP BY orderkey),
gl AS (
  SELECT CAST(0 AS BIGINT) AS line_no, concat('H', chr(9), 'VN:Z:1.1') AS line
  UNION ALL SELECT line_no + 1, CASE WHEN line_no % 97 = 5 THEN concat_ws(chr(9), 'S', name) WHEN line_no % 97 = 6 THEN concat_ws(chr(9), 'S', name, '*')
    WHEN line_no % 97 = 7 THEN concat_ws(chr(9), 'S', name, concat(sequence, 'X')) ELSE concat_ws(chr(9), 'S', name, sequence, 'LN:i:1') END FROM seg
  UNION ALL SELECT orderkey + 1000000000, CASE WHEN orderkey % 89 = 5 THEN concat_ws(chr(9), 'P', concat('o', orderkey))
    ELSE concat_ws(chr(9), 'P', concat('o', orderkey), CASE WHEN orderkey % 89 = 4 THEN concat(t, ',') ELSE t END, CASE orderkey % 89 WHEN 3 THEN '1M'
      WHEN 6 THEN concat_ws(',', CASE WHEN commas > 0 THEN repeat('0M,', commas - 1) || '0M' ELSE '' END) WHEN 7 THEN repeat('0M,', commas) || '0M' ELSE '*' END) END FROM pt
  UNION ALL SELECT c_custkey + 2000000000, concat_ws(chr(9), 'W', concat('c', c_custkey), CASE WHEN c_custkey % 31 = 2 THEN 'x' ELSE '1' END, 'chr',
    CASE WHEN c_custkey % 7 = 0 THEN '*' ELSE CAST(c_custkey % 5 AS VARCHAR) END, CASE WHEN c_custkey % 7 = 0 THEN '*' ELSE CAST(c_custkey % 11 AS VARCHAR) END,
    CASE WHEN c_custkey % 13 = 1 THEN '12' ELSE concat('>', c_custkey, '<', c_custkey + 1) END) FROM customer),
f AS (SELECT line_no, string_split(line, chr(9)) AS x FROM gl),
fs AS (SELECT line_no, x[2] AS name, x[3] AS q FROM f WHERE x[1] = 'S' AND len(x) >= 3),
fp AS (SELECT line_no, x[2] AS identifier, string_split(x[3], ',') AS t, x[4] AS "overlaps" FROM f WHERE x[1] = 'P' AND len(x) >= 4),
pp AS (SELECT *, len(list_filter(t, lambda y: NOT (length(y) >= 2 AND right(y, 1) IN ('+', '-')))) > 0 AS bad FROM fp),
fw AS (SELECT line_no, concat_ws('#', x[2], x[3], x[4]) AS identifier, x[5] AS s, x[6] AS e, x[7] AS t, NOT regexp_full_match(x[7], '([><][^><]+)*') AS bad FROM f WHERE x[1] = 'W' AND len(x) >= 7)
"""
_NAMES = """nm AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN concat('00', c_custkey) WHEN c_custkey % 4 = 1 THEN concat(c_custkey, 'x')
  WHEN c_custkey % 4 = 2 THEN concat('18446744073709551', c_custkey % 1000 + 100) ELSE CAST(c_custkey AS VARCHAR) END AS name FROM customer),
nn AS (SELECT name, CASE WHEN regexp_full_match(name, '[0-9]+') AND CAST(name AS HUGEINT) <= 18446744073709551615 THEN CAST(name AS HUGEINT) END AS v FROM
  (SELECT name FROM nm WHERE regexp_full_match(name, '[0-9]+')) UNION ALL SELECT name, NULL FROM nm WHERE NOT regexp_full_match(name, '[0-9]+'))"""
_RANGED = """rw AS (SELECT CAST(o_orderkey AS BIGINT) AS line_no, concat('w', o_custkey) AS identifier, o_orderkey % 50 = 1 AS unbounded,
  CAST((o_orderkey * 37) % 1000 AS BIGINT) AS start, CAST((o_orderkey * 37) % 1000 + 20 + o_orderkey % 60 AS BIGINT) AS "end" FROM orders)"""
_NAMED = """sn AS (SELECT CAST(s_suppkey AS BIGINT) AS line_no, concat(CASE WHEN s_suppkey % 2 = 1 THEN '0' ELSE '' END, s_suppkey % 40) AS name, s_suppkey % 3 <> 0 AS valid,
  CASE WHEN s_suppkey % 40 > 0 THEN CAST(s_suppkey % 40 AS VARCHAR) ELSE concat('$', CASE WHEN s_suppkey % 2 = 1 THEN '00' ELSE '0' END) END AS key FROM supplier)"""


def _base(sql: str) -> str:
    return f"WITH {_BASE} {sql}"


def _on_walks(sql: str) -> str:
    return f"WITH {_BASE} {_WALKS} {sql}"


def _on_lines(sql: str) -> str:
    return f"WITH {_BASE} {_LINES} {sql}"


_BAD = f"[^{S.ALPHABET}{S.ALPHABET.lower()}]"
_AGG = """CAST(count(source_index) AS BIGINT) AS source_sequences, CAST(count(*) FILTER (length(g) > 0 OR source_index IS NULL) AS BIGINT) AS graph_traversals,
  CAST(coalesce(sum(length(s)), 0) AS BIGINT) AS source_bases, CAST(coalesce(sum(length(g)), 0) AS BIGINT) AS graph_bases,
  CAST(coalesce(sum(length(translate(g, 'ACGT', ''))), 0) AS BIGINT) AS graph_ambiguous_bases,
  CAST(coalesce(sum(CASE status WHEN 'IDENTICAL' THEN 0 WHEN 'DIVERGENT' THEN levenshtein(s, g) END), 0) AS BIGINT) AS edit_distance, CAST(0 AS BIGINT) AS not_embedded,
  CAST(coalesce(sum(length(s)) FILTER (status = 'MISSING_PATH'), 0) AS BIGINT) AS missing_path_bases, CAST(coalesce(sum(length(g)) FILTER (status = 'MISSING_SOURCE'), 0) AS BIGINT) AS missing_source_bases,
  count(*) FILTER (status = 'IDENTICAL') AS identical, count(*) FILTER (status = 'DIVERGENT') AS divergent, count(*) FILTER (status = 'MISSING_PATH') AS missing_path, count(*) FILTER (status = 'MISSING_SOURCE') AS missing_source"""

ORACLES = {
    "fasta_scan": f"""SELECT row_number() OVER (ORDER BY s_suppkey) AS record_no, s_name AS name,
      concat(CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE substr(q, 1, CAST(s_suppkey % 20 AS BIGINT)) END, lower(substr(q, 21, 12))) AS sequence
      FROM (SELECT *, translate(md5(CAST(s_suppkey AS VARCHAR)), '{B.DIGITS}', '{B.BASES}') AS q FROM supplier)""",
    "gfa_scan_records": _on_lines("SELECT x[1] AS kind, count(*) AS n, CAST(sum(len(x)) AS BIGINT) AS n_fields FROM f GROUP BY 1"),
    "gfa_header_version": _on_lines("SELECT substr(x[2], 6) AS version FROM f WHERE x[1] = 'H'"),
    "segment_scan": _on_lines(f"SELECT line_no, name, q AS sequence, q <> '*' AND NOT regexp_matches(q, '{_BAD}') AS valid FROM fs"),
    "path_scan": _on_lines("SELECT line_no, identifier, CASE WHEN NOT bad THEN len(t) END AS n_steps, \"overlaps\" FROM pp"),
    "walk_scan": _on_lines("""SELECT line_no, identifier, CASE WHEN NOT bad THEN len(regexp_extract_all(t, '[><][^><]+')) END AS n_steps, s = '*' AND e = '*' AS unbounded,
      coalesce(TRY_CAST(s AS BIGINT) < TRY_CAST(e AS BIGINT), false) AS ranged FROM fw"""),
    "path_steps_parse": _on_lines("SELECT line_no, CASE WHEN NOT bad THEN left(t[1], -1) END AS first_segment, CASE WHEN NOT bad THEN right(t[1], 1) END AS first_orientation, bad AS malformed FROM pp"),
    "walk_steps_parse": _on_lines("""SELECT line_no, CASE WHEN NOT bad THEN substr(regexp_extract_all(t, '[><][^><]+')[2], 2) END AS second_segment,
      CASE WHEN NOT bad THEN CASE left(regexp_extract_all(t, '[><][^><]+')[2], 1) WHEN '<' THEN '-' WHEN '>' THEN '+' END END AS second_orientation, bad AS malformed FROM fw"""),
    "iupac_validate": _on_lines(f"SELECT line_no, coalesce(NOT regexp_matches(x[3], '{_BAD}'), false) AS valid FROM f WHERE x[1] = 'S'"),
    "first_invalid_symbol": _on_lines(f"SELECT line_no, CAST(strpos(q, regexp_extract(q, '{_BAD}')) AS BIGINT) AS position, regexp_extract(q, '{_BAD}') AS symbol FROM fs WHERE regexp_matches(q, '{_BAD}')"),
    "ambiguous_count": _base("SELECT name, CAST(length(translate(sequence, 'ACGTacgt', '')) AS BIGINT) AS ambiguous FROM seg"),
    "complement_iupac": _base(f"SELECT name, translate(sequence, '{S.LETTERS}', '{S.COMPLEMENTS}') AS complement FROM seg"),
    "reverse_complement": _base(f"SELECT name, translate(reverse(sequence), '{S.LETTERS}', '{S.COMPLEMENTS}') AS reversed FROM seg"),
    "segment_position": _base("SELECT orderkey, step_no, CAST(CASE WHEN orientation = '-' THEN length(bases) - 2 ELSE 3 END AS BIGINT) AS position FROM ori"),
    "numeric_name": f"WITH {_NAMES} SELECT name, CAST(v AS VARCHAR) AS number FROM nn",
    "canonical_segment": f"WITH {_NAMES} SELECT name, CASE WHEN v > 0 THEN concat('#', v) ELSE concat('$', name) END AS key FROM nn",
    "identifier_mapping": "SELECT CAST(c_custkey AS BIGINT) AS custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN concat('s', c_nationkey, '#1#', c_name) ELSE concat('pre-', c_name) END AS identifier FROM customer",
    "overlap_blunt": _on_lines("""SELECT line_no, "overlaps" = '*' OR (NOT bad AND len(t) > 1 AND len(string_split("overlaps", ',')) = len(t) - 1 AND regexp_full_match("overlaps", '0M(,0M)*')) AS blunt FROM pp"""),
    "sha256_sequence": _base("SELECT name, sha256(upper(lower(sequence))) AS sha256 FROM seg"),
    "dup_source_ids": """SELECT identifier, source_index, record_no FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY source_index, record_no) AS k FROM
      (SELECT concat('n', c_nationkey, '-', c_custkey % 50) AS identifier, CAST(c_custkey % 3 AS BIGINT) AS source_index, CAST(c_custkey AS BIGINT) AS record_no FROM customer)) WHERE k > 1""",
    "dup_segments": f"WITH {_NAMED} SELECT line_no, name FROM (SELECT *, max(valid) OVER (PARTITION BY key ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM sn) WHERE seen",
    "dup_paths": "SELECT line_no, identifier FROM (SELECT CAST(o_orderkey AS BIGINT) AS line_no, concat('p', o_custkey) AS identifier, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k > 1",
    "path_walk_conflict": "SELECT concat('i', o_custkey) AS identifier FROM orders INTERSECT SELECT concat('i', c_custkey) FROM customer",
    "ambiguous_walk_ranges": f"WITH {_RANGED} SELECT identifier FROM rw GROUP BY 1 HAVING count(*) > 1 AND bool_or(unbounded)",
    "walk_range_overlap": f"""WITH {_RANGED} SELECT identifier, start, "end", previous_end, k FROM (SELECT *, lag("end") OVER o AS previous_end, row_number() OVER o AS k FROM rw WHERE NOT unbounded
      WINDOW o AS (PARTITION BY identifier ORDER BY start, "end", line_no)) WHERE start < previous_end""",
    "walk_range_bounds": f"""WITH {_RANGED} SELECT line_no, identifier, "end", CAST(c_custkey % 1000 AS BIGINT) AS source_length FROM rw JOIN customer ON identifier = concat('w', c_custkey) WHERE NOT unbounded AND "end" > c_custkey % 1000""",
    "unresolved_segments": f"""WITH {_NAMED}, tr AS (SELECT CAST(c_custkey % 60 AS BIGINT) AS line_no, concat('c', c_custkey % 100) AS identifier, unnest([c_custkey % 45, c_custkey % 37]) AS v FROM customer)
      SELECT DISTINCT CAST(v AS VARCHAR) AS segment, identifier FROM tr WHERE NOT EXISTS (SELECT 1 FROM sn WHERE valid AND sn.line_no < tr.line_no AND key = CASE WHEN v > 0 THEN CAST(v AS VARCHAR) ELSE '$0' END)
      AND NOT EXISTS (SELECT 1 FROM sn WHERE sn.line_no > tr.line_no AND name = CAST(v AS VARCHAR))""",
    "step_segment_join": _base("SELECT * FROM ori"),
    "reconstruct_path": _base("SELECT orderkey, CAST(length(graph) AS BIGINT) AS length, sha256(graph) AS sha256, CAST(length(translate(graph, 'ACGT', '')) AS BIGINT) AS ambiguous FROM gr"),
    "reconstruct_walk": _base("SELECT identifier, CAST(length(g) AS BIGINT) AS length, sha256(g) AS sha256 FROM (SELECT identifier, string_agg(graph, '' ORDER BY start) AS g FROM w GROUP BY 1)"),
    "source_range": _base('SELECT identifier, min(start) AS range_start, max("end") AS range_end FROM w GROUP BY 1'),
    "addressed_bases": _base('SELECT identifier, CAST(sum("end" - start) AS BIGINT) AS addressed FROM w GROUP BY 1'),
    "addressed_digest": _base("SELECT identifier, sha256(s) AS sha256 FROM oc WHERE status IN ('IDENTICAL', 'DIVERGENT')"),
    "missing_path": _base("SELECT identifier, CAST(length(s) AS BIGINT) AS source_length FROM oc WHERE status = 'MISSING_PATH'"),
    "missing_source": _base("SELECT identifier, CAST(length(g) AS BIGINT) AS graph_length FROM oc WHERE status = 'MISSING_SOURCE'"),
    "full_outcome_status": _base("SELECT identifier, status, CAST(length(s) AS BIGINT) AS source_length, CAST(length(g) AS BIGINT) AS graph_length FROM oc"),
    "step_offsets": _base("""SELECT concat('o', orderkey) AS identifier, step_no, CAST(o AS BIGINT) AS "offset", CAST(greatest(0, least(n, length(sequence) - o)) AS BIGINT) AS "limit" FROM
      (SELECT *, length(bases) AS n, coalesce(sum(length(bases)) OVER (PARTITION BY orderkey ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM ori) JOIN src ON identifier = concat('o', orderkey)"""),
    "first_divergence": _base("SELECT identifier, CAST(pos AS BIGINT) AS source_position_1based FROM oc WHERE status = 'DIVERGENT'"),
    "divergence_kind": _base("SELECT identifier, kind AS divergence_kind FROM oc WHERE status = 'DIVERGENT'"),
    "range_length_mismatch": _base('SELECT identifier, start, "end" - start AS range_length, n AS walk_length FROM w WHERE "end" - start <> n'),
    "edit_distance": _base("SELECT identifier, CAST(levenshtein(s, g) AS BIGINT) AS edit_distance FROM oc WHERE status = 'DIVERGENT'"),
    "alignment_limit": _base("SELECT identifier, CASE WHEN d * d + d + length(s) - length(g) + 1 <= 4 THEN 'complete' ELSE 'limit_exceeded' END AS alignment_status FROM (SELECT *, levenshtein(s, g) AS d FROM oc WHERE status = 'DIVERGENT')"),
    "memory_limit": _base("SELECT identifier, CASE WHEN length(s) + length(g) > 150 THEN 'memory_limit_exceeded' ELSE 'complete' END AS alignment_status, CAST(CASE WHEN length(s) + length(g) > 150 THEN length(s) ELSE 0 END AS BIGINT) AS unaligned_divergent_source FROM oc WHERE status = 'DIVERGENT'"),
    # A source differs from its graph by one letter changed, added or left out at most, which the lengths tell.
    "base_partition": _base("""SELECT identifier, CAST(CASE status WHEN 'IDENTICAL' THEN length(g) WHEN 'DIVERGENT' THEN least(length(s), length(g)) - one ELSE 0 END AS BIGINT) AS matched,
      CAST(CASE WHEN status = 'DIVERGENT' THEN one ELSE 0 END AS BIGINT) AS substituted,
      CAST(CASE WHEN status = 'DIVERGENT' THEN greatest(length(s) - length(g), 0) ELSE 0 END AS BIGINT) AS source_only, CAST(CASE WHEN status = 'DIVERGENT' THEN greatest(length(g) - length(s), 0) ELSE 0 END AS BIGINT) AS graph_only,
      CAST(0 AS BIGINT) AS not_embedded, CAST(CASE WHEN status = 'MISSING_PATH' THEN length(s) ELSE 0 END AS BIGINT) AS missing_path_bases, CAST(CASE WHEN status = 'MISSING_SOURCE' THEN length(g) ELSE 0 END AS BIGINT) AS missing_source_bases
      FROM (SELECT *, CASE WHEN length(s) = length(g) THEN 1 ELSE 0 END AS one FROM oc)"""),
    "summary_counts": _base("SELECT count(*) FILTER (status = 'IDENTICAL') AS identical, count(*) FILTER (status = 'DIVERGENT') AS divergent, count(*) FILTER (status = 'MISSING_PATH') AS missing_path, count(*) FILTER (status = 'MISSING_SOURCE') AS missing_source, count(*) AS total FROM oc"),
    "percentages": _base("SELECT status, round(100.0 * count(*) / (SELECT count(*) FROM oc), 6) AS percentage FROM oc GROUP BY 1"),
    "aggregate_global_source_type": _base(f"""SELECT CAST(level AS BIGINT) AS level, source_index, record_type, * EXCLUDE (level, source_index, record_type) FROM (
      SELECT 3 AS level, CAST(NULL AS BIGINT) AS source_index, CAST(NULL AS VARCHAR) AS record_type, {_AGG} FROM oc
      UNION ALL SELECT 1, source_index, NULL, {_AGG} FROM oc WHERE source_index IS NOT NULL GROUP BY source_index
      UNION ALL SELECT 2, NULL, 'P', {_AGG} FROM oc WHERE g IS NOT NULL)"""),
    "record_counts": _on_lines("SELECT (SELECT count(*) FROM fp) AS path_records, (SELECT bool_or(\"overlaps\" = '*') FROM fp) AS starred, (SELECT count(*) FROM fw) AS walk_records"),
    "walks_per_identifier": _base("SELECT identifier, count(*) AS n FROM w GROUP BY 1"),
    "distinct_names": _on_lines("SELECT 'P' AS record_type, count(DISTINCT identifier) AS n FROM fp UNION ALL SELECT 'W', count(DISTINCT identifier) FROM fw"),
    "walk_outcomes": _on_walks("""SELECT identifier, status, 'W' AS record_type, kind AS divergence_kind, dv + 1 AS source_position_1based, CAST(length(s) AS BIGINT) AS source_length, CAST(length(g) AS BIGINT) AS graph_length,
      CASE WHEN kind = 'RANGE_LENGTH' THEN wanted END AS range_length, CASE WHEN kind = 'RANGE_LENGTH' THEN held END AS walk_length FROM wo"""),
    "walk_addressed_digest": _on_walks("""SELECT identifier, sha256(string_agg(substr(s, CAST(start + 1 AS BIGINT), "end" - start), '' ORDER BY start)) AS sha256 FROM w JOIN ws USING (identifier) GROUP BY 1"""),
    "walk_aggregates": _on_walks("""
      , wa AS (SELECT *, k % 2 + 1 AS si FROM wo JOIN (SELECT identifier, sum("end" - start) AS addressed FROM w GROUP BY 1) USING (identifier))
      SELECT CAST(level AS BIGINT) AS level, * EXCLUDE (level) FROM (
      SELECT 3 AS level, CAST(NULL AS BIGINT) AS source_index, CAST(NULL AS VARCHAR) AS record_type, count(*) AS source_sequences, count(*) AS graph_traversals, CAST(sum(length(s)) AS BIGINT) AS source_bases, CAST(sum(length(g)) AS BIGINT) AS graph_bases, CAST(sum(length(s) - addressed) AS BIGINT) AS not_embedded, count(*) FILTER (status = 'IDENTICAL') AS identical, count(*) FILTER (status = 'DIVERGENT') AS divergent FROM wa
      UNION ALL SELECT 1, si, NULL, count(*) AS source_sequences, count(*) AS graph_traversals, CAST(sum(length(s)) AS BIGINT) AS source_bases, CAST(sum(length(g)) AS BIGINT) AS graph_bases, CAST(sum(length(s) - addressed) AS BIGINT) AS not_embedded, count(*) FILTER (status = 'IDENTICAL') AS identical, count(*) FILTER (status = 'DIVERGENT') AS divergent FROM wa GROUP BY si
      UNION ALL SELECT 2, NULL, 'W', count(*) AS source_sequences, count(*) AS graph_traversals, CAST(sum(length(s)) AS BIGINT) AS source_bases, CAST(sum(length(g)) AS BIGINT) AS graph_bases, CAST(sum(length(s) - addressed) AS BIGINT) AS not_embedded, count(*) FILTER (status = 'IDENTICAL') AS identical, count(*) FILTER (status = 'DIVERGENT') AS divergent FROM wa)"""),
    "records_sorted": _base("""SELECT identifier, row_number() OVER (PARTITION BY identifier ORDER BY start, "end", orderkey) AS rec, orderkey AS line_no, start, "end" FROM w"""),
    "union_sources": "SELECT CAST(1 AS BIGINT) AS source_index, concat('c', c_custkey) AS identifier FROM customer UNION ALL SELECT 2, concat('s', s_suppkey) FROM supplier",
    "outcomes_sorted": _base("SELECT identifier, status FROM oc ORDER BY identifier"),
    "chunked_range_join": _base("""SELECT concat('o', orderkey) AS identifier, step_no, substr(sequence, CAST(o + 1 AS BIGINT), CAST(least(n, length(sequence) - o) AS BIGINT)) AS there FROM
      (SELECT *, length(bases) AS n, coalesce(sum(length(bases)) OVER (PARTITION BY orderkey ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM ori) JOIN src ON identifier = concat('o', orderkey) WHERE least(n, length(sequence) - o) > 0"""),
}
