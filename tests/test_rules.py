"""Rules that stop an audit, arguments, and the pieces below."""

import random

import pytest

from braidcheck.api import audit_gfa, audit_outcomes, diagnostics_frame
from braidcheck.errors import ArgumentError, InputError
from braidcheck.functions.digests import blake3_many
from braidcheck.operators.align import align


@pytest.mark.parametrize(
    "fasta, gfa, codes",
    [
        ([">dup\nAC\n", ">dup\nGT\n"], "S 1 AC;P dup 1+ *", {"DUPLICATE_SEQUENCE_IDENTIFIER"}),
        (">dup\nAC\n>dup\nGT\n", "S 1 AX;P dup broken *;S 2 AZ", {"DUPLICATE_SEQUENCE_IDENTIFIER", "INVALID_NUCLEOTIDE", "MALFORMED_PATH"}),
        (">sample\nAC\n", "S 1 AC;S 2 *;P sample 1+,missing+ 1M", {"SEQUENCELESS_SEGMENT", "UNSUPPORTED_OVERLAP", "UNRESOLVED_SEGMENT"}),
        (">sample\nAC\n", "S 1 A;S 2 C;P sample 1+,2+ 1M;P sample 1+,2+ *", {"UNSUPPORTED_OVERLAP", "DUPLICATE_PATH"}),
        (">sample\nAC\n", "S 1;P sample 1+ *", {"MALFORMED_S_RECORD", "UNRESOLVED_SEGMENT"}),
        (">s#1#c\nACGT\n", "S 1 AC;W s 1 c 0 2 >1;W s 1 c 1 3 >1;W s x c 0 2", {"W_RANGE_OVERLAP", "MALFORMED_W_RECORD"}),
        (">s#1#c\nAC\n", "S 1 AC;P s#1#c 1+ *;W s 1 c * * >1;W s 1 c * * >1", {"DUPLICATE_EMBEDDED_PATH", "AMBIGUOUS_W_RANGES"}),
        (">s#1#c\nAC\n", "S 1 AC;W s x c 0 2 >1;W s 1 c 0 3 >1;W s 1 d 5 5 >1;W s 1 e * 5 1", {"INVALID_HAPLOTYPE", "W_RANGE_OUT_OF_BOUNDS", "INVALID_W_RANGE", "MALFORMED_WALK"}),
        ("AC\n", "S 1 AC;S 01 AC;P x 1+ 0M", {"INVALID_FASTA", "DUPLICATE_SEGMENT", "UNSUPPORTED_OVERLAP"}),
        ("", "S 1 AC;P x 1+", {"INVALID_FASTA", "MALFORMED_P_RECORD"}),
    ],
)
def test_codes(audit, fasta, gfa, codes):
    with pytest.raises(InputError) as e:
        audit(fasta, gfa)
    assert set(e.value.codes) == codes


def test_symbol_and_place(audit, spark):
    with pytest.raises(InputError) as e:
        audit(">sample\nACX\n", "S 1 AC;P sample 1+ *")
    (d,) = e.value.diagnostics
    assert (d["code"], d["identifier"], d["position"], d["symbol"]) == ("INVALID_SOURCE_NUCLEOTIDE", "sample", 3, "X")
    assert diagnostics_frame(spark, e.value).count() == 1


def test_adjacent_overlaps_only(audit):
    with pytest.raises(InputError) as e:
        audit(">s#1#c\nACGTACGTAC\n", "S 1 A;W s 1 c 0 10 >1;W s 1 c 1 2 >1;W s 1 c 3 4 >1")
    assert e.value.codes == ["W_RANGE_OVERLAP"]


def test_missing_files(spark, tmp_path):
    with pytest.raises(InputError) as e:
        audit_gfa(spark, str(tmp_path / "none.fa"), str(tmp_path / "none.gfa"))
    assert e.value.codes == ["FASTA_READ", "GFA_READ"]


@pytest.mark.parametrize(
    "options",
    [
        dict(mapping=[{"mode": "bad"}]),
        dict(mapping=[{"mode": "pansn", "sample": "s", "haplotype": "h"}]),
        dict(mapping=[{"mode": "prefix"}]),
        dict(mapping=[]),
        dict(threads=0),
        dict(memory_mib=0),
        dict(alignment_max_cells=1.5),
        dict(statistics="all"),
        dict(fasta=[]),
        dict(fasta=""),
        dict(fasta=["a.fa", 3]),
        dict(fasta={"x": {"bad\nname": "AC"}}),
        dict(fasta={"x": {" ": "AC"}}),
        dict(gfa=""),
    ],
)
def test_arguments(options):
    with pytest.raises(ArgumentError):
        audit_gfa(None, **({"fasta": "a.fa", "gfa": "b.gfa"} | options))


def test_accessor_of_something_else():
    with pytest.raises(ArgumentError, match="not dict"):
        audit_outcomes({})


def test_sequences_in_memory(spark, tmp_path):
    graph = tmp_path / "g.gfa"
    graph.write_text("S\t1\tACGT\nS\t2\tTTGG\nP\tchr1\t1+\t*\nP\thap#chr2\t2+\t*\n")
    path = tmp_path / "a.fa"
    path.write_text(">chr1\nACGT\n")
    r = audit_gfa(spark, [("first", [("chr1", "ACGT")]), ("other", {"chr2 described": "TTGG"})], str(graph), mapping=[{"mode": "exact"}, {"mode": "prefix", "prefix": "hap#"}])
    assert [(x["identifier"], x["status"], x["source_index"]) for x in r.outcomes.collect()] == [("chr1", "IDENTICAL", 1), ("hap#chr2", "IDENTICAL", 2)]
    assert r.provenance["fasta"] == ["<DataFrame first>", "<DataFrame other>"]
    r.close()


def test_blake3_against_the_jvm(spark):
    r = random.Random(1)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3073, 8193, 31 * 1024 + 5)]
    jvm = spark._jvm.org.apache.commons.codec.digest.Blake3
    assert blake3_many(texts) == [bytes(b & 255 for b in jvm.hash(t)).hex() for t in texts]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("a, b, want", [("ACGT", "CGTA", (3, 0, 1, 1, 7)), ("ACGTACGT", "TACGTAC", (6, 0, 2, 1, 14)), ("GATTACA", "GCATGCT", (3, 4, 0, 0, 21)), ("", "AC", (0, 0, 0, 2, 5))])
def test_alignment_split(a, b, want):
    x = align(a, b)
    assert (x.matched, x.substituted, x.source_only, x.graph_only, x.cells) == want


def test_alignment_of_random_pairs():
    r = random.Random(1729)
    for _ in range(400):
        a, b = ("".join(r.choice("ACGTN"[: r.randint(1, 5)]) for _ in range(r.randint(0, 12))) for _ in range(2))
        x, d = align(a, b), _distance(a, b)
        assert x.edit_distance == d and x.cells == (1 if a == b else d * d + d + len(a) - len(b) + 1)
        assert x.matched + x.substituted + x.source_only == len(a) and x.matched + x.substituted + x.graph_only == len(b)
        assert align(a, b, x.cells) is not None and align(a, b, x.cells - 1) is None


def test_many_diagnostics(audit, spark, monkeypatch):
    """An error holds the first ones, its frame all, in the same order."""
    import braidcheck.api as api

    monkeypatch.setattr(api, "MOST_DIAGNOSTICS", 3)
    with pytest.raises(InputError) as e:
        audit(">sample\nACGT\n", "S 1 AX;S 2 AQ;S 3 AZ;S 4 AJ;P sample 1+ *")
    assert [d["line"] for d in e.value.diagnostics] == [1, 2, 3]
    every = diagnostics_frame(spark, e.value).collect()
    assert [r["line"] for r in every][:4] == [1, 2, 3, 4] and len(every) > 4
    assert set(every[0].asDict()) == set(e.value.diagnostics[0])


def test_operational_codes():
    from braidcheck.api import _failure

    told = {"java.lang.OutOfMemoryError: Java heap space": "OUT_OF_MEMORY", "java.io.IOException: No space left on device": "TEMP_STORE", "else": "AUDIT_FAILED"}
    assert {t: _failure(Exception(t)).codes[0] for t in told} == told
    assert _failure(MemoryError()).codes == ["OUT_OF_MEMORY"]
