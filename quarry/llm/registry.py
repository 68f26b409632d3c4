"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import op6_chat, op7_quality
from .op1_minhash import op1_minhash_near_dedup
from .op2_windows import op2_substring_dedup
from .op3_bpe import op3_byte_bpe
from .op4_decontam import op4_decontaminate
from .op5_html import op5_main_text
from .op6_chat import op6_chat_format
from .op7_quality import op7_quality_rules
from .op8_suffixes import op8_suffix_array_dedup
from .op9_tokens import op9_token_counts
from .op10_secrets import op10_secret_scan
from .op11_whiten import op11_embedding_whitening
from .op12_spelling import op12_spelling_variants
from .op13_ctw import op13_lm_scoring

_ALL = (
    op1_minhash_near_dedup, op2_substring_dedup, op3_byte_bpe, op4_decontaminate, op5_main_text, op6_chat_format, op7_quality_rules, op8_suffix_array_dedup,
    op9_token_counts, op10_secret_scan, op11_embedding_whitening, op12_spelling_variants, op13_lm_scoring,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op6_chat_format": op6_chat.ORACLE, "op7_quality_rules": op7_quality.ORACLE}
