"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from . import chat, content_sort, divergence, html_text, language, line_dedup, mixing, neighbours, packing, quality, resampling, simhash, toxicity

QUERIES = {
    "op1_language": language.op1_language,
    "op2_simhash": simhash.op2_simhash,
    "op3_exact_dedup": content_sort.op3_exact_dedup,
    "op4_packing": packing.op4_packing,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mixing": mixing.op7_mixing,
    "op8_html": html_text.op8_html,
    "op9_chat": chat.op9_chat,
    "op10_quality": quality.op10_quality,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_divergence": divergence.op12_divergence,
    "op13_resampling": resampling.op13_resampling,
}

SQL = {
    "op3_exact_dedup": content_sort.OP3_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_chat": chat.OP9_SQL,
    "op11_line_dedup": line_dedup.OP11_SQL,
    "op12_divergence": divergence.OP12_SQL,
    "op13_resampling": resampling.OP13_SQL,
}
