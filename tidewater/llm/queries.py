"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewater.llm import chat, classify, decontaminate, html_extract, mixing, near_dedup, pii, prefix_trie, secrets, topk, url_filter, whitening

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_exact_topk": topk.op4_exact_topk,
    "op5_quality_classifier": classify.op5_quality_classifier,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_toxicity": classify.op7_toxicity,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_pii": pii.op9_pii,
    "op10_url_filters": url_filter.op10_url_filters,
    "op11_html_extraction": html_extract.op11_html_extraction,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
SQL = {
    "op1_minhash_near_dedup": near_dedup.OP1_SQL,
    "op3_chat_formatting": chat.OP3_SQL,
    "op4_exact_topk": topk.OP4_SQL,
    "op6_secret_scans": secrets.OP6_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op10_url_filters": url_filter.OP10_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
