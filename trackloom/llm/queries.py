"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from trackloom.llm.forest import OP5_SQL, op5_embeddings
from trackloom.llm.lines import OP1_SQL, op1_lines
from trackloom.llm.mixing import TARGETS_SQL, mixing_targets, op2_mixing
from trackloom.llm.packing import op10_packing
from trackloom.llm.phrases import OP12_SQL, op12_phrases
from trackloom.llm.quality import op3_quality
from trackloom.llm.rules import BASE_SQL as RULES_SQL
from trackloom.llm.rules import op11_rules, rules_base
from trackloom.llm.secrets import BASE_SQL, op4_secrets, secrets_base
from trackloom.llm.simhash import op8_simhash
from trackloom.llm.substrings import OP6_SQL, op6_substrings
from trackloom.llm.trie import OP13_SQL, op13_trie
from trackloom.llm.topk import OP9_SQL, op9_topk
from trackloom.llm.urls import OP7_SQL, op7_urls

QUERIES = {
    "op1_lines": op1_lines,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_embeddings": op5_embeddings,
    "op6_substrings": op6_substrings,
    "op7_urls": op7_urls,
    "op8_simhash": op8_simhash,
    "op9_topk": op9_topk,
    "op10_packing": op10_packing,
    "op11_rules": op11_rules,
    "op12_phrases": op12_phrases,
    "op13_trie": op13_trie,
    # Of operators that SQL cannot tell in whole, what it can.
    "mixing_targets": mixing_targets,
    "secrets_base": secrets_base,
    "rules_base": rules_base,
}
SQL = {"rules_base": RULES_SQL, "op12_phrases": OP12_SQL, "op13_trie": OP13_SQL, "op1_lines": OP1_SQL, "op5_embeddings": OP5_SQL, "op6_substrings": OP6_SQL, "op7_urls": OP7_SQL, "op9_topk": OP9_SQL, "mixing_targets": TARGETS_SQL, "secrets_base": BASE_SQL}
