"""The text operators' queries, one per operator over its whole table."""

from __future__ import annotations

from .html import op9_html
from .importance import ORACLE_OP13, op13_importance
from .jaccard import op12_jaccard
from .merkle import ORACLE_OP11, op11_merkle
from .mixing import ORACLE_OP5, op5_mixing
from .neighbours import op3_neighbours
from .packing import op6_packing
from .quality import ORACLE_OP2, op2_quality
from .secrets import op4_secrets
from .simhash import op1_simhash
from .substrings import op10_substrings
from .toxicity import op8_toxicity
from .urls import op7_urls

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_neighbours": op3_neighbours,
    "op4_secrets": op4_secrets,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_urls": op7_urls,
    "op8_toxicity": op8_toxicity,
    "op9_html": op9_html,
    "op10_substrings": op10_substrings,
    "op11_merkle": op11_merkle,
    "op12_jaccard": op12_jaccard,
    "op13_importance": op13_importance,
}
ORACLES = {"op2_quality": ORACLE_OP2, "op5_mixing": ORACLE_OP5, "op11_merkle": ORACLE_OP11, "op13_importance": ORACLE_OP13}
