"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .alignment import op13_alignment
from .byte_bpe import op10_byte_bpe
from .chat import OP3_SQL, op3_chat
from .decontaminate import op4_decontaminate
from .divergence import OP11_SQL, op11_divergence
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .jaccard_join import op7_jaccard_join
from .language import op8_language
from .line_dedup import op1_line_dedup
from .quality import op5_quality
from .substring_dedup import OP12_SQL, op12_substring_dedup
from .token_files import op6_token_files
from .toxicity import op9_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat": op3_chat,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_token_files": op6_token_files,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_divergence": op11_divergence,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL = {"op3_chat": OP3_SQL, "op2_exact_dedup": OP2_SQL, "op11_divergence": OP11_SQL, "op12_substring_dedup": OP12_SQL}
