"""The production queries of the training-data operators, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP13_SQL, op13_phrase_collocations
from .conversations import op11_conversation_repair
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .language import op8_language_id
from .media import op5_media_webp
from .mixing import OP9_SQL, op9_source_mixing
from .near_dedup import op10_minhash_near_dedup
from .packing import op6_best_fit_packing
from .quality import op4_quality_classifier
from .simhash import op12_simhash_near_dedup
from .token_counts import op3_token_counts
from .toxicity import op2_toxicity
from .warc import OP7_SQL, op7_warc

OPERATORS = (
    op1_exact_dedup,
    op2_toxicity,
    op3_token_counts,
    op4_quality_classifier,
    op5_media_webp,
    op6_best_fit_packing,
    op7_warc,
    op8_language_id,
    op9_source_mixing,
    op10_minhash_near_dedup,
    op11_conversation_repair,
    op12_simhash_near_dedup,
    op13_phrase_collocations,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op7_warc": OP7_SQL, "op9_source_mixing": OP9_SQL, "op13_phrase_collocations": OP13_SQL}
