"""Queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op11_byte_bpe
from .conversation_trie import OP13_SQL, op13_conversation_trie
from .decontamination import op10_template_decontamination
from .fill_middle import op12_fill_middle
from .jaccard_join import op6_parity_sketch_join
from .line_dedup import OP2_SQL, op2_line_dedup
from .packing import op4_best_fit_packing
from .personal_data import op3_weak_supervision_pii
from .pitman_yor import op1_pitman_yor_scores
from .quality import op8_quality_classifier
from .secret_scan import op7_secret_novelty
from .sharding import op5_feistel_sharding
from .vector_search import op9_anisotropic_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor_scores": op1_pitman_yor_scores,
    "op2_line_dedup": op2_line_dedup,
    "op3_weak_supervision_pii": op3_weak_supervision_pii,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_feistel_sharding": op5_feistel_sharding,
    "op6_parity_sketch_join": op6_parity_sketch_join,
    "op7_secret_novelty": op7_secret_novelty,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_anisotropic_search": op9_anisotropic_search,
    "op10_template_decontamination": op10_template_decontamination,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_fill_middle": op12_fill_middle,
    "op13_conversation_trie": op13_conversation_trie,
}

SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op13_conversation_trie": OP13_SQL}
