"""The registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from .bpe_codec import op2
from .chain_dedup import op5
from .chat_format import OP13_SQL, op13
from .divergence import OP11_SQL, op11
from .exact_dedup import OP9_SQL, op9
from .packing import op7
from .quality_classifier import op6
from .quality_rules import OP3_SQL, op3
from .simhash import op4
from .suffix_dedup import OP8_SQL, op8
from .token_counts import op1
from .toxicity import op10
from .vector_codes import OP12_SQL, op12


def queries():
    return {
        "op1_token_counts": op1,
        "op2_bpe_codec": op2,
        "op3_quality_rules": op3,
        "op4_simhash_dedup": op4,
        "op5_chain_dedup": op5,
        "op6_quality_classifier": op6,
        "op7_packing": op7,
        "op8_suffix_dedup": op8,
        "op9_exact_dedup": op9,
        "op10_toxicity": op10,
        "op11_source_divergence": op11,
        "op12_vector_codes": op12,
        "op13_chat_format": op13,
    }


def oracle_sql():
    return {
        "op3_quality_rules": OP3_SQL,
        "op8_suffix_dedup": OP8_SQL,
        "op9_exact_dedup": OP9_SQL,
        "op11_source_divergence": OP11_SQL,
        "op12_vector_codes": OP12_SQL,
        "op13_chat_format": OP13_SQL,
    }
