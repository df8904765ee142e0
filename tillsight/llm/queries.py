"""Registered queries of the subpackage, and their SQL where there is one."""

from __future__ import annotations

from tillsight.llm.bpe import op5_bpe_automaton
from tillsight.llm.hard_negatives import ORACLE_OP13, op13_angular_negatives
from tillsight.llm.html_cut import op9_html_min_cut
from tillsight.llm.kdtree import ORACLE_OP1, op1_kdtree_topk
from tillsight.llm.line_dedup import op7_line_templates
from tillsight.llm.ngram_join import op8_ngram_jaccard_join
from tillsight.llm.packing import op6_best_fit_packing
from tillsight.llm.quality import op10_quality_rules
from tillsight.llm.setsketch import op11_setsketch
from tillsight.llm.spelling import op12_gram_spelling
from tillsight.llm.suffix_dedup import op4_suffix_dedup
from tillsight.llm.url_filter import ORACLE_OP2, op2_url_filter
from tillsight.llm.warc import op3_warc_derivatives

QUERIES = {f.__name__: f for f in (op1_kdtree_topk, op2_url_filter, op3_warc_derivatives, op4_suffix_dedup, op5_bpe_automaton,
                                   op6_best_fit_packing, op7_line_templates, op8_ngram_jaccard_join, op9_html_min_cut, op10_quality_rules,
                                   op11_setsketch, op12_gram_spelling, op13_angular_negatives)}
ORACLE = {"op1_kdtree_topk": ORACLE_OP1, "op2_url_filter": ORACLE_OP2, "op13_angular_negatives": ORACLE_OP13}
