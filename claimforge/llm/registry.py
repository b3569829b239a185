"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP2_SQL, op2_chat_format
from .decontaminate import OP1_SQL, op1_decontaminate
from .exact_dedup import OP12_SQL, op12_exact_dedup
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .language_id import op10_language_id
from .mixing import OP4_SQL, op4_mixing
from .near_dedup import op3_near_dedup
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_classifier import op7_quality_classifier
from .quality_rules import op6_quality_rules, op6_sql
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .token_counts import op9_token_counts
from .token_output import op5_token_output


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_chat_format": op2_chat_format,
        "op3_near_dedup": op3_near_dedup,
        "op4_mixing": op4_mixing,
        "op5_token_output": op5_token_output,
        "op6_quality_rules": op6_quality_rules,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_token_counts": op9_token_counts,
        "op10_language_id": op10_language_id,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_hard_negatives": op13_hard_negatives,
    }


def llm_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": OP1_SQL,
        "op2_chat_format": OP2_SQL,
        "op4_mixing": OP4_SQL,
        "op6_quality_rules": op6_sql(),
        "op8_substring_dedup": OP8_SQL,
        "op11_prefix_trie": OP11_SQL,
        "op12_exact_dedup": OP12_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
