"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from soundlattice.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from soundlattice.llm.language_model import op3_language_model
from soundlattice.llm.mixing import op7_mixing
from soundlattice.llm.packing import op4_packing
from soundlattice.llm.pii import op10_personal_data
from soundlattice.llm.quality_rules import OP2_SQL, op2_quality_rules
from soundlattice.llm.simhash import op6_simhash
from soundlattice.llm.suffix_dedup import op8_suffix_dedup
from soundlattice.llm.token_counts import op1_token_counts
from soundlattice.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_model": op3_language_model,
    "op4_packing": op4_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_personal_data": op10_personal_data,
}

SQL: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op5_exact_dedup": OP5_SQL}
