"""Queries of the corpus operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP3_SQL, op3_chat_format
from .decontamination import OP8_SQL, op8_decontamination
from .language_id import op4_language_id
from .merkle import OP12_SQL, op12_merkle_manifest
from .near_duplicates import OP1_SQL, op1_near_duplicates
from .neighbours import OP13_SQL, op13_nearest_neighbours
from .packing import op10_packing
from .pii import op7_pii
from .resampling import OP11_SQL, op11_importance_resampling
from .substring_dedup import OP5_SQL, op5_substring_dedup
from .topk import OP2_SQL, op2_exact_top_k
from .toxicity import op6_toxicity
from .url_filter import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_chat_format": op3_chat_format,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_packing": op10_packing,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

ORACLE_SQL = {
    "op1_near_duplicates": OP1_SQL,
    "op2_exact_top_k": OP2_SQL,
    "op3_chat_format": OP3_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_nearest_neighbours": OP13_SQL,
}
