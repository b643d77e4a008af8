"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pagewarden.llm import alignment, bpe_tree, chat_trees, code_compression, decontaminate, language, main_text, media, near_dup, quality, secrets, token_count, token_files

QUERIES = {
    "op1_guess_cost_secrets": secrets.query,
    "op2_hyperdimensional_language": language.query,
    "op3_interleaved_media": media.query,
    "op4_factorisation_quality": quality.query,
    "op5_order_minhash": near_dup.query,
    "op6_block_main_text": main_text.query,
    "op7_transducer_token_counts": token_count.query,
    "op8_bpe_tree": bpe_tree.query,
    "op9_mixed_range_coder": token_files.query,
    "op10_winnowing": decontaminate.query,
    "op11_reply_tree_chats": chat_trees.query,
    "op12_cross_tokenizer_alignment": alignment.query,
    "op13_cover_tree_codes": code_compression.query,
}
SQL = {"op10_winnowing": decontaminate.SQL}
