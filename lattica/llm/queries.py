"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, divergence, merkle, sharding
from .ann import op7_additive_quantisation
from .decontamination import op13_benchmark_decontamination
from .divergence import op12_source_divergence
from .html_extraction import op3_html_extraction
from .language_id import op9_language_id
from .merkle import op11_merkle_manifest
from .near_dedup import op2_minhash_near_dedup
from .packing import op10_best_fit_packing
from .quality_classifier import op5_quality_classifier
from .quality_rules import op6_quality_rules
from .sentencepiece_sampling import op1_sentencepiece_gumbel
from .sharding import op8_extendible_sharding
from .token_counts import op4_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_gumbel": op1_sentencepiece_gumbel,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_token_counts": op4_token_counts,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_additive_quantisation": op7_additive_quantisation,
    "op8_extendible_sharding": op8_extendible_sharding,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_divergence": op12_source_divergence,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}

#: The others can't be said in SQL: the tests hold them against brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {"op8_extendible_sharding": sharding.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_benchmark_decontamination": decontamination.ORACLE}
