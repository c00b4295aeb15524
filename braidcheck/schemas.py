"""Schemas that are part of the contract."""

from __future__ import annotations

# The outcome columns in their order, with their types.
OUTCOMES = [
    ("identifier", "string"),
    ("source_index", "long"),
    ("status", "string"),
    ("record_type", "string"),
    ("source_start_0based", "long"),
    ("source_end_0based_exclusive", "long"),
    ("source_length", "long"),
    ("graph_length", "long"),
    ("addressed_source_bases", "long"),
    ("divergence_kind", "string"),
    ("source_position_1based", "long"),
    ("graph_position_1based", "long"),
    ("segment", "string"),
    ("orientation", "string"),
    ("traversal_position_1based", "long"),
    ("segment_position_1based", "long"),
    ("range_length", "long"),
    ("walk_length", "long"),
    ("source_sha256", "string"),
    ("addressed_source_sha256", "string"),
    ("graph_sha256", "string"),
    ("source_blake3", "string"),
    ("addressed_source_blake3", "string"),
    ("graph_blake3", "string"),
    ("source_ambiguous_bases", "long"),
    ("graph_ambiguous_bases", "long"),
    ("ambiguous_columns", "long"),
    ("length_delta", "long"),
    ("matched", "long"),
    ("substituted", "long"),
    ("source_only", "long"),
    ("graph_only", "long"),
    ("not_embedded", "long"),
    ("missing_path_bases", "long"),
    ("missing_source_bases", "long"),
    ("unaligned_divergent_source", "long"),
    ("unaligned_divergent_graph", "long"),
    ("edit_distance", "long"),
    ("alignment_status", "string"),
]
OUTCOME_COLUMNS = [name for name, _ in OUTCOMES]

# The parts into which a comprehensive audit divides all bases.
BASE_PARTS = [
    "matched",
    "substituted",
    "source_only",
    "graph_only",
    "not_embedded",
    "missing_path_bases",
    "missing_source_bases",
    "unaligned_divergent_source",
    "unaligned_divergent_graph",
]
STATUSES = ["IDENTICAL", "DIVERGENT", "MISSING_PATH", "MISSING_SOURCE"]

DIAGNOSTICS = "category string, code string, message string, path string, line double, identifier string, position double, symbol string, details map<string,string>"
