"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from tidemark.llm.chat_format import ORACLE as OP6_SQL
from tidemark.llm.chat_format import op6_chat_reply_trees
from tidemark.llm.embedding_dedup import op10_embedding_nn_descent
from tidemark.llm.fingerprints import op9_simhash_tables
from tidemark.llm.html_extract import op1_html_suffix_array
from tidemark.llm.language_id import op7_language_fusion
from tidemark.llm.mixing import op4_mix_sainte_lague
from tidemark.llm.packing import op3_pack_nnls
from tidemark.llm.pii import op2_pii_weak_supervision
from tidemark.llm.simhash_dedup import op8_simhash_vantage
from tidemark.llm.suffix_dedup import op5_suffix_array_dedup

QUERIES = {
    "op1_html_suffix_array": op1_html_suffix_array,
    "op2_pii_weak_supervision": op2_pii_weak_supervision,
    "op3_pack_nnls": op3_pack_nnls,
    "op4_mix_sainte_lague": op4_mix_sainte_lague,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_chat_reply_trees": op6_chat_reply_trees,
    "op7_language_fusion": op7_language_fusion,
    "op8_simhash_vantage": op8_simhash_vantage,
    "op9_simhash_tables": op9_simhash_tables,
    "op10_embedding_nn_descent": op10_embedding_nn_descent,
}

ORACLES: dict[str, str] = {"op6_chat_reply_trees": OP6_SQL}
