"""Queries of this package and their SQL."""

from __future__ import annotations

from riskloom.llm.byte_bpe import op6_byte_bpe
from riskloom.llm.chat_windows import OP3_SQL, op3_chat_windows
from riskloom.llm.chosen_path import OP9_SQL, op9_chosen_path
from riskloom.llm.collocations import OP12_SQL, op12_collocations
from riskloom.llm.hilbert_neighbours import op4_hilbert_neighbours
from riskloom.llm.language import op7_language
from riskloom.llm.line_runs import OP13_SQL, op13_line_runs
from riskloom.llm.mixing import OP1_SQL, op1_mixing
from riskloom.llm.pii_disclosure import op8_pii_disclosure
from riskloom.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from riskloom.llm.quality_lines import OP2_SQL, op2_quality_lines
from riskloom.llm.secret_randomness import op10_secret_randomness
from riskloom.llm.suffix_dedup import OP5_SQL, op5_suffix_dedup

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_lines": op2_quality_lines,
    "op3_chat_windows": op3_chat_windows,
    "op4_hilbert_neighbours": op4_hilbert_neighbours,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language": op7_language,
    "op8_pii_disclosure": op8_pii_disclosure,
    "op9_chosen_path": op9_chosen_path,
    "op10_secret_randomness": op10_secret_randomness,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_line_runs": op13_line_runs,
}
ORACLE = {
    "op1_mixing": OP1_SQL,
    "op2_quality_lines": OP2_SQL,
    "op3_chat_windows": OP3_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op9_chosen_path": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_line_runs": OP13_SQL,
}
