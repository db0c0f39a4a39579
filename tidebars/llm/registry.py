"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tidebars.llm.bpe import op9_bpe
from tidebars.llm.conversation_trie import OP13_SQL, op13_conversation_trie
from tidebars.llm.exact_dedup import OP12_SQL, op12_exact_dedup
from tidebars.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from tidebars.llm.html_text import op5_html_text
from tidebars.llm.jaccard_join import OP6_SQL, op6_jaccard_join
from tidebars.llm.language_id import op2_language_id
from tidebars.llm.license_scan import OP4_SQL, op4_license_scan
from tidebars.llm.quality_rules import OP10_SQL, op10_quality_rules
from tidebars.llm.secret_scan import op8_secret_scan
from tidebars.llm.source_mix import op3_source_mix
from tidebars.llm.topk_search import OP1_SQL, op1_topk_search
from tidebars.llm.url_filter import OP7_SQL, op7_url_filter

QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_language_id": op2_language_id,
    "op3_source_mix": op3_source_mix,
    "op4_license_scan": op4_license_scan,
    "op5_html_text": op5_html_text,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_url_filter": op7_url_filter,
    "op8_secret_scan": op8_secret_scan,
    "op9_bpe": op9_bpe,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLES = {
    "op1_topk_search": OP1_SQL,
    "op4_license_scan": OP4_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op7_url_filter": OP7_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_conversation_trie": OP13_SQL,
}
