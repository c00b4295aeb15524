"""Queries of this package and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat_formatting
from .decontaminate import op5_benchmark_decontamination
from .fingerprints import op1_document_fingerprints
from .idfiles import op10_token_id_files
from .language import op2_language_id
from .maxent import op3_lm_scoring
from .neardup import op4_minhash_near_dedup
from .packing import op6_best_fit_packing
from .substrings import op8_suffix_array_dedup
from .urls import op7_url_filters

QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_language_id": op2_language_id,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_filters": op7_url_filters,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_token_id_files": op10_token_id_files,
}

ORACLES: dict[str, str] = {"op9_chat_formatting": OP9_SQL}
