"""Outcomes on small inputs: identity, divergences, walks, digests, statistics."""

import pytest

from braidcheck.errors import InputError
from braidcheck.schemas import OUTCOME_COLUMNS


def rows(result):
    return {r["identifier"]: r.asDict() for r in result.outcomes.collect()}


def one(result):
    (row,) = rows(result).values()
    return row


def has(row, **want):
    assert {k: row[k] for k in want} == want


def test_identical_path_and_digests(audit):
    for bases in ("ACGT", "acgt"):
        r = audit(f">sample\n{bases}\n", "H VN:Z:1.1;S 1 AC;S 2 GT;P sample 1+,2+ *")
        has(
            one(r),
            status="IDENTICAL",
            record_type="P",
            source_sha256="1dff3e84fe7877e0673b69bbddcf40124e396e3f9943dd890c91b6a09adb9af0",
            graph_blake3="6ddb6a816aee59efb41923edb5d485f56aa781184a68b3d405438c7422c0090f",
            matched=None,
            alignment_status=None,
        )
        assert r.provenance["gfa_version"] == "1.1" and r.statistics == {} and r.outcomes.columns == OUTCOME_COLUMNS
        assert repr(r).endswith("topology validated: no")


def test_walk_of_two_ranges(audit):
    r = audit(">sample#1#chr1\nACGT\nGT\n", "S 1 AC;S 2 GT;W sample 1 chr1 0 2 >1;W sample 1 chr1 4 6 >2", statistics="comprehensive")
    row = one(r)
    has(row, status="IDENTICAL", record_type="W", source_start_0based=0, source_end_0based_exclusive=6, addressed_source_bases=4, matched=4, not_embedded=2)
    assert row["addressed_source_sha256"] == row["graph_sha256"] != row["source_sha256"]
    assert row["addressed_source_blake3"] == row["graph_blake3"] != row["source_blake3"]


@pytest.mark.parametrize(
    "fasta, gfa, want",
    [
        (">s\nacga\n", "S 1 AC;S 2 GT;P s 1+,2+ *", dict(divergence_kind="BASE", source_position_1based=4, segment="2", segment_position_1based=2)),
        (">b#1#c\nACGTGCAACC\n", "H VN:Z:1.0;S 1 ACGT;S 2 TTGA;S 3 CC;P b#1#c 1+,2-,3+ *", dict(orientation="-", source_position_1based=5, traversal_position_1based=1, segment_position_1based=4)),
        (">s\nACGT\n", "S 1 ACG;P s 1+ *", dict(divergence_kind="END", source_position_1based=4, segment=None)),
        (">s\nACG\n", "S 1 AC;S 2 GT;P s 1+,2+ *", dict(divergence_kind="BASE", source_position_1based=4, segment="2", orientation="+", traversal_position_1based=2, segment_position_1based=2)),
        (">s#1#c\nACGT\n", "S 1 ACG;W s 1 c 0 2 >1", dict(divergence_kind="RANGE_LENGTH", range_length=2, walk_length=3, segment=None)),
        (">s#1#c\nAT\n", "S 1 AC;W s 1 c 0 2 >1", dict(record_type="W", source_start_0based=0, source_end_0based_exclusive=2, source_position_1based=2, segment="1", segment_position_1based=2)),
        (">s#1#c\nACTTGTA\n", "S 1 AC;S 2 GT;W s 1 c 0 3 >1;W s 1 c 4 7 >2", dict(divergence_kind="END", source_position_1based=3)),
        (">s#1#c\nACTTGTA\n", "S 1 AC;S 2 GT;W s 1 c 0 1 >1;W s 1 c 4 7 >2", dict(divergence_kind="BASE", source_position_1based=2, segment="1", traversal_position_1based=2)),
        (">s#1#c\nAC\n", "S 1 AC;W s 1 c 0 2 _", dict(divergence_kind="RANGE_LENGTH", range_length=2, walk_length=0, source_position_1based=1)),
        (">s\nAC\n", "S 1 AN;P s 1+ *", dict(divergence_kind="BASE", source_position_1based=2)),
    ],
)
def test_divergences(audit, fasta, gfa, want):
    row = one(audit(fasta, gfa))
    has(row, status="DIVERGENT", **want)
    assert row["graph_position_1based"] == row["source_position_1based"]


@pytest.mark.parametrize(
    "fasta, gfa",
    [
        (">s\nNBDHVKMWSRYACGT\n", "S 1 ACGTRYSWKMBDHVN;P s 1- *"),
        (">s#1#c\nACGT\n", "H VN:Z:1.1;S 1 AC;S 2 GT;W s 1 c * * >1>2"),
        (">s#1#c\nACGT\n", "S 1 AC;S 2 GT;W s 1 c 2 4 >2;W s 1 c 0 2 >1"),
        (">x\nAC\n", "S 01 AC;P x 1+ *"),
        (">s\r\nAC\r\nGT", "S 1 AC;S 2 GT;P s 1+,2+ 0M"),
        ("\n> s extra words\nAC\n\nGT\n", "S 1 AC;S 2 GT;P s 1+,2+ 0M;L 1 + 2 + 5M;# any thing"),
    ],
)
def test_identical(audit, fasta, gfa):
    assert one(audit(fasta, gfa))["status"] == "IDENTICAL"


def test_prefix_of_source_by_unbounded_walk(audit):
    row = one(audit(">s#1#c\nACGT\n", "S 1 AC;W s 1 c * * >1", statistics="comprehensive"))
    has(row, status="IDENTICAL", graph_length=2, length_delta=-2)
    assert row["graph_sha256"] != row["source_sha256"]


def test_mixed_statuses_in_order(audit):
    r = audit(">present\nAC\n>absent\nNN\n", "S 1 AC;S 2 GG;P present 1+ *;P extra 2+ *")
    assert [(x["identifier"], x["status"]) for x in r.outcomes.collect()] == [("absent", "MISSING_PATH"), ("extra", "MISSING_SOURCE"), ("present", "IDENTICAL")]
    assert r.summary["counts"] == {"identical": 1, "divergent": 0, "missing_path": 1, "missing_source": 1} and r.summary["total"] == 3
    assert abs(r.summary["percentages"]["identical"] - 100 / 3) < 1e-9


def test_walk_without_source(audit):
    r = rows(audit(">present\nAC\n", "S 1 AN;S 2 AC;W extra 1 chr1 * * >1>1;P present 2+ *", statistics="comprehensive"))["extra#1#chr1"]
    has(r, status="MISSING_SOURCE", record_type="W", graph_length=4, missing_source_bases=4, graph_ambiguous_bases=2, source_ambiguous_bases=0, alignment_status="not_applicable")


def test_mappings(audit):
    mapping = [{"mode": "pansn", "sample": "sample", "haplotype": "1"}, {"mode": "prefix", "prefix": "pre-"}]
    r = rows(audit([">chr1\nAC\n", ">chr2\nGT\n"], "S 1 AC;S 2 GT;P sample#1#chr1 1+ *;P pre-chr2 2+ *", mapping=mapping))
    assert {k: (v["status"], v["source_index"]) for k, v in r.items()} == {"pre-chr2": ("IDENTICAL", 2), "sample#1#chr1": ("IDENTICAL", 1)}


def test_gzip_by_content(audit):
    r = audit(">sample\nACGT\n", "S 1 AC;S 2 GT;P sample 1+,2+ *", zipped=True, threads=3, memory_mib=7)
    assert one(r)["status"] == "IDENTICAL"
    assert r.provenance["fasta_compressions"] == ["gzip"] and r.provenance["gfa_compression"] == "gzip"
    assert r.provenance["threads"] == 3 and r.telemetry["limit_bytes"] == 7 * 1024**2 and r.provenance["gfa_version"] == "inferred-1.x"


def test_last_version_wins(audit):
    r = audit(">s#1#c\nAC\n", "H VN:Z:1.0 VN:Z:1.1;H VN:Z:1.2;S 1 AC;W s 1 c * * >1")
    assert r.provenance["gfa_version"] == "1.2" and r.provenance["path_records"] == 0 and r.provenance["walk_records"] == 1
    assert r.provenance["unspecified_overlaps_as_blunt"] is False


def test_base_partition(audit):
    r = audit(">same\nACGT\n>changed\nAAAA\n>absent\nNN\n", "S 1 ACGT;S 2 AATA;S 3 GG;P same 1+ *;P changed 2+ *;P extra 3+ *", statistics="comprehensive")
    g = r.statistics["global"]
    assert (g["source_bases"], g["graph_bases"], g["source_ambiguous_bases"]) == (10, 10, 2)
    assert {k: v for k, v in g["bases"].items() if v} == {"matched": 7, "substituted": 1, "missing_path_bases": 2, "missing_source_bases": 2}
    assert g["source_sequences"] == 3 and g["graph_traversals"] == 3 and g["completed_alignments"] == 1 and g["edit_distance"] == 1 and g["aligned_columns"] == 8
    assert r.statistics["by_record_type"]["P"]["bases"]["missing_source_bases"] == 2 and r.statistics["by_source"][0]["statuses"]["missing_path"] == 1
    assert r.telemetry["peak_tracked_bytes"] == 8


@pytest.mark.parametrize(
    "source, graph, cells, want",
    [
        ("AAAA", "AATA", 10**7, dict(alignment_status="complete", matched=3, substituted=1, edit_distance=1)),
        ("ACGT", "AGT", 10**7, dict(source_only=1, graph_only=0, length_delta=-1)),
        ("AAAA", "TTTT", 20, dict(alignment_status="limit_exceeded", edit_distance=None, unaligned_divergent_source=4, unaligned_divergent_graph=4)),
        ("AAAA", "TTTT", 21, dict(alignment_status="complete", edit_distance=4)),
    ],
)
def test_alignment(audit, source, graph, cells, want):
    has(one(audit(f">c\n{source}\n", f"S 1 {graph};P c 1+ *", statistics="comprehensive", alignment_max_cells=cells)), **want)


def test_records_share_the_cells(audit):
    # Two records of one substitution each take 3 points each.
    case = (">s#1#c\nAAAATTTT\n", "S 1 AACA;S 2 TTGT;W s 1 c 0 4 >1;W s 1 c 4 8 >2")
    has(one(audit(*case, statistics="comprehensive", alignment_max_cells=6)), alignment_status="complete", substituted=2)
    has(one(audit(*case, statistics="comprehensive", alignment_max_cells=5)), alignment_status="limit_exceeded", unaligned_divergent_graph=8)


def test_memory_limit(audit):
    r = audit(">changed\n" + "A" * 700_000, "S 1 " + "T" * 700_000 + ";P changed 1+ *", statistics="comprehensive", memory_mib=1, threads=2)
    has(one(r), alignment_status="memory_limit_exceeded", unaligned_divergent_source=700_000)
    assert r.telemetry["peak_tracked_bytes"] <= 700_000
    big = audit(">large\n" + "A" * 1_100_000, "S 1 " + "A" * 1_100_000 + ";P large 1+ *", memory_mib=1, threads=4)
    assert one(big)["status"] == "IDENTICAL" and big.telemetry["oversized_contigs"] == 1 and big.telemetry["peak_tracked_bytes"] == 1_100_000


def test_long_sequences_cross_chunks(audit):
    import random

    r = random.Random(7)
    source = "".join(r.choice("ACGT") for _ in range(70_000))
    changed = source[:40_123] + ("A" if source[40_123] != "A" else "C") + source[40_124:]
    row = one(audit(f">s\n{source}\n", f"S a {changed[:100]};S b {changed[100:60_000]};S c {changed[60_000:]};P s a+,b+,c+ *"))
    has(row, divergence_kind="BASE", source_position_1based=40_124, segment="b", traversal_position_1based=40_024)


@pytest.mark.parametrize("gfa", ["S 1 AC;P x 01+ *;S 1 AC", "S 0 AC;P x 00+ *"])
def test_names(audit, gfa):
    with pytest.raises(InputError) as e:
        audit(">x\nAC\n", gfa)
    assert "UNRESOLVED_SEGMENT" in e.value.codes or "DUPLICATE_SEGMENT" in e.value.codes


@pytest.mark.parametrize("name, zipped", [("large.gz", True), ("large.fa", True), ("plain.gz", False)])
def test_large_files_are_streamed(spark, tmp_path, monkeypatch, name, zipped):
    import gzip

    from braidcheck.sources import lines as L

    monkeypatch.setattr(L, "WHOLE_FILE", 10)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    # Two members, one carriage return, no line feed at the end.
    texts = [f">s{i}\r\nAC{'GT' * i}\n".encode() for i in range(500)]
    halves = [b"".join(texts[:250]), b"".join(texts[250:]).rstrip(b"\n")]
    path = tmp_path / name
    path.write_bytes(b"".join(gzip.compress(h) for h in halves) if zipped else b"".join(halves))
    got = [(r["line_no"], r["line"], r["error"]) for r in L.read_lines(spark, str(path)).orderBy("line_no").collect()]
    want = [x for i in range(500) for x in (f">s{i}", "AC" + "GT" * i)]
    assert got == [(i + 1, x, None) for i, x in enumerate(want)]
    if zipped:
        path.write_bytes(gzip.compress(b"".join(halves))[:-20])
        assert [r["error"] for r in L.read_lines(spark, str(path)).collect()] == ["unexpected end of file"]
