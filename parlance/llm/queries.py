"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, chat, goodness, html, langid, mixing, negatives, packing, pii, quality, repeats, simhash, trie

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_packing": packing.op2_packing,
    "op3_mixing": mixing.op3_mixing,
    "op4_repeats": repeats.op4_repeats,
    "op5_simhash": simhash.op5_simhash,
    "op6_chat": chat.op6_chat,
    "op7_quality": quality.op7_quality,
    "op8_html": html.op8_html,
    "op9_language": langid.op9_language,
    "op10_neighbours": ann.op10_neighbours,
    "op11_trie": trie.op11_trie,
    "op12_goodness": goodness.op12_goodness,
    "op13_negatives": negatives.op13_negatives,
}
SQL = {"op6_chat": chat.OP6_SQL, "op7_quality": quality.OP7_SQL}
