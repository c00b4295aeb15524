"""What keeps the audit's cost in proportion to its input: passes over the tables, alignments without tables of points."""

import os
import random

import pytest
from pyspark.sql import functions as F

from braidcheck import queries as Q
from braidcheck.operators import align as A
from braidcheck.operators import compare

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n\n")[0]


@pytest.mark.parametrize(
    "name, sorts",
    [
        ("full_outcome_status", 5), ("first_divergence", 5), ("divergence_kind", 5), ("summary_counts", 5), ("percentages", 5), ("outcomes_sorted", 6), ("outcomes_with_digests", 5),
        ("edit_distance", 5), ("base_partition", 5), ("memory_limit", 5), ("alignment_limit", 5), ("aggregate_global_source_type", 5),
        ("walk_outcomes", 5), ("walk_aggregates", 5), ("walk_addressed_digest", 5), ("reconstruct_walk", 5), ("step_offsets", 4), ("chunked_range_join", 8),
    ],
)
def test_items_are_read_and_sorted_few_times(spark, name, sorts):
    """Sources and traversals read the items once each, and nothing of theirs is joined again to what it was made of."""
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    plan = _plan(Q.QUERIES[name](spark, SF))
    assert plan.count("sf0.001/lineitem") <= 2 and plan.count("Sort [") <= sorts


def _changed(r, text):
    k = r.randrange(len(text) + 1)
    return r.choice([text[:k] + r.choice("ACGTNacgtn") + text[k + 1 :], text[:k] + r.choice("ACGTN") + text[k:], text[:k] + text[k + 1 :], text.swapcase()])


def test_one_edit_needs_no_points(monkeypatch):
    r = random.Random(5)
    pairs = []
    for _ in range(600):
        text = "".join(r.choice("ACGTNRacgt"[: r.randint(1, 10)]) for _ in range(r.randint(0, 30)))
        pairs.append((text, _changed(r, text)))
    got = [[A.align(*p, cells) for cells in (10**7, 4, 3, 2, 1, 0)] for p in pairs]
    with monkeypatch.context() as m:
        m.setattr(A, "_run", lambda *_: pytest.fail("tables of points for one edit"))
        assert [A.align(*p) for p in pairs] == [g[0] for g in got]
    monkeypatch.setattr(A, "_near", lambda *_: None)
    assert [[A.align(*p, cells) for cells in (10**7, 4, 3, 2, 1, 0)] for p in pairs] == got


def test_first_difference_in_texts_of_any_length(spark):
    r = random.Random(6)
    rows = []
    for n in (1, 2, 7, 8, 127, 128, 254, 255, 256, 257, 5000, 70_001):
        text = "".join(r.choice("ACGTN") for _ in range(n))
        for k in sorted({0, 1 % n, n // 2, n - 1}):
            other = text[:k] + ("C" if text[k] != "C" else "A") + "".join(r.choice("ACGTN") for _ in range(n - k - 1))
            rows.append((text, other.lower(), n, k))
        rows.append((text, text.lower(), n, None))
        rows.append((text + "A", text + "C", n, None))
    df = spark.createDataFrame(rows, "a string, b string, n int, want long")
    got = df.select("want", compare.first_difference(F.col("a"), F.col("b"), F.col("n")).cast("long").alias("got")).collect()
    assert [x["got"] for x in got] == [x["want"] for x in got]


def test_records_without_steps_keep_their_place(spark):
    """Records with no steps, in any place among those of an identifier, are parts without bases."""
    schema = "line_no long, identifier string, record_type string, start long, end long, steps array<struct<segment:string,orientation:string>>"
    walks = spark.createDataFrame([(3, "w", "W", 4, 6, [("2", "+")]), (1, "w", "W", 0, 2, [("1", "+")]), (2, "w", "W", 2, 4, []), (4, "e", "W", None, None, []), (5, "p", "P", None, None, [("1", "-"), ("2", "+")])], schema)
    segments = spark.createDataFrame([(1, "1", "#1", "AC", True), (2, "2", "#2", "NT", True)], "line_no long, name string, key string, sequence string, valid boolean")
    sources = spark.createDataFrame([("w", 1, "ACAANT"), ("p", 1, "GTNA"), ("e", 1, "A")], "identifier string, source_index long, sequence string")
    rows = {x["identifier"]: x for x in compare.outcomes(sources, walks, segments).collect()}
    w, p, e = rows["w"], rows["p"], rows["e"]
    assert [(x["start"], x["graph"]) for x in w["parts"]] == [(0, "AC"), (2, ""), (4, "NT")]
    # The end of the part without bases is the first event, its last one too.
    assert (w["status"], w["divergence_kind"], w["source_position_1based"], w["range_length"], w["walk_length"]) == ("DIVERGENT", "RANGE_LENGTH", 3, 2, 0)
    assert (w["graph"], w["graph_length"], w["graph_ambiguous_bases"], w["addressed"]) == ("ACNT", 4, 1, "ACAANT")
    assert (p["status"], p["divergence_kind"], p["source_position_1based"], p["segment"], p["orientation"], p["traversal_position_1based"], p["segment_position_1based"]) == ("DIVERGENT", "BASE", 4, "2", "+", 2, 2)
    assert (e["status"], e["graph"], e["graph_length"]) == ("IDENTICAL", "", 0)
