"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from .alignment import op12_alignment
from .chat import OP3_SQL, op3_chat
from .html import op2_html
from .lexical import OP13_SQL, op13_lexical
from .mixing import OP9_SQL, op9_mixing
from .neardup import OP6_SQL, op6_near_duplicates
from .packing import op1_packing
from .privacy import op5_privacy
from .quality import op10_quality
from .search import OP4_SQL, op4_search
from .substrings import OP8_SQL, op8_substrings
from .toxicity import op7_toxicity
from .warc import OP11_SQL, op11_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_html": op2_html,
    "op3_chat": op3_chat,
    "op4_search": op4_search,
    "op5_privacy": op5_privacy,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_substrings": op8_substrings,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_warc": op11_warc,
    "op12_alignment": op12_alignment,
    "op13_lexical": op13_lexical,
}

ORACLES = {"op3_chat": OP3_SQL, "op4_search": OP4_SQL, "op6_near_duplicates": OP6_SQL, "op8_substrings": OP8_SQL, "op9_mixing": OP9_SQL, "op11_warc": OP11_SQL, "op13_lexical": OP13_SQL}
