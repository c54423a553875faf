"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from gridloom.llm import ann, chat, crosstok, decontaminate, lmscore, mixing, neardup, pii, quality, repair, substring, topk, urlfilter

QUERIES = {
    "op1_template_decontamination": decontaminate.op1_template_decontamination,
    "op2_chat_windows": chat.op2_chat_windows,
    "op3_hnsw": ann.op3_hnsw,
    "op4_quality_fm": quality.op4_quality_fm,
    "op5_url_cascade": urlfilter.op5_url_cascade,
    "op6_contextual_pii": pii.op6_contextual_pii,
    "op7_pseudo_likelihood": lmscore.op7_pseudo_likelihood,
    "op8_debruijn": substring.op8_debruijn,
    "op9_source_mix": mixing.op9_source_mix,
    "op10_bagminhash": neardup.op10_bagminhash,
    "op11_suffix_automaton": repair.op11_suffix_automaton,
    "op12_term_at_a_time": topk.op12_term_at_a_time,
    "op13_incidence_products": crosstok.op13_incidence_products,
}
SQL = {"op5_url_cascade": urlfilter.OP5_SQL, "op8_debruijn": substring.OP8_SQL, "op9_source_mix": mixing.OP9_SQL, "op10_bagminhash": neardup.OP10_SQL, "op11_suffix_automaton": repair.OP11_SQL, "op12_term_at_a_time": topk.OP12_SQL}
