"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from . import conversation_repair, filter_audit
from .byte_bpe import op4_byte_bpe
from .chosen_path import op13_chosen_path
from .conversation_repair import op12_conversation_repair
from .filter_audit import op11_filter_audit
from .language_id import op7_language_id
from .license_scan import op3_license_scan
from .media_jpeg import op8_media_jpeg
from .mixing import op5_mixing
from .quality_rules import op10_quality_rules
from .simhash import op2_simhash
from .substring_dedup import op1_substring_dedup
from .suffix_array_dedup import op6_suffix_array_dedup
from .token_counts import op9_token_counts

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash": op2_simhash,
    "op3_license_scan": op3_license_scan,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_mixing": op5_mixing,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_language_id": op7_language_id,
    "op8_media_jpeg": op8_media_jpeg,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_chosen_path": op13_chosen_path,
}

#: The others have no SQL: suffix structures, BK-trees, tokenizers, files, trained models and robust estimates are beyond it.
SQL: dict[str, str] = {"op11_filter_audit": filter_audit.SQL, "op12_conversation_repair": conversation_repair.SQL}
