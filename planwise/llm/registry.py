"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from planwise.llm.chat_windows import op12_chat_windows
from planwise.llm.decontaminate import op3_decontamination
from planwise.llm.lm_score import op1_lm_score
from planwise.llm.near_dedup import op5_near_dedup
from planwise.llm.packing import op2_packing
from planwise.llm.prefix_trie import ORACLE_OP11, op11_conversation_trie
from planwise.llm.quality import op6_quality
from planwise.llm.sharding import op10_sharding
from planwise.llm.structure_repair import ORACLE_OP13, op13_structure_repair
from planwise.llm.substrings import op8_substring_dedup
from planwise.llm.topk import ORACLE_OP9, op9_exact_topk
from planwise.llm.toxicity import op7_toxicity
from planwise.llm.warc import ORACLE_OP4, op4_warc

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_exact_topk": op9_exact_topk,
    "op10_sharding": op10_sharding,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_chat_windows": op12_chat_windows,
    "op13_structure_repair": op13_structure_repair,
}
ORACLE: dict[str, str] = {
    "op4_warc": ORACLE_OP4,
    "op9_exact_topk": ORACLE_OP9,
    "op11_conversation_trie": ORACLE_OP11,
    "op13_structure_repair": ORACLE_OP13,
}
