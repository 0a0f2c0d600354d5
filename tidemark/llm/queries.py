"""The queries that apply these operators to their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_bpe
from .decontaminate import OP3_SQL, op3_decontaminate
from .language_id import op9_language_id
from .lm import op8_lm_score
from .media import op2_media_copies
from .minhash import OP6_SQL, op6_minhash
from .substring_dedup import OP7_SQL, op7_substring_dedup
from .suffix_dedup import OP4_SQL, op4_suffix_dedup
from .token_counts import op10_token_counts
from .url_filter import op1_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_media_copies": op2_media_copies,
        "op3_decontaminate": op3_decontaminate,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_bpe": op5_bpe,
        "op6_minhash": op6_minhash,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_lm_score": op8_lm_score,
        "op9_language_id": op9_language_id,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op6_minhash": OP6_SQL, "op7_substring_dedup": OP7_SQL}
