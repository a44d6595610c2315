"""Registered queries of the corpus operators."""

from __future__ import annotations

from catalith.llm.decontaminate import op3_decontaminate
from catalith.llm.jaccard_join import OP8_SQL, op8_jaccard_join
from catalith.llm.kd_search import OP6_SQL, op6_kd_search
from catalith.llm.language_id import op5_language_id
from catalith.llm.license_scan import op2_license_scan
from catalith.llm.lm_score import op9_lm_score
from catalith.llm.mixing import op7_mixing
from catalith.llm.sharding import op10_sharding
from catalith.llm.suffix_dedup import op1_suffix_dedup
from catalith.llm.token_counts import op4_token_counts

QUERIES: dict = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_kd_search": op6_kd_search,
    "op7_mixing": op7_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_lm_score": op9_lm_score,
    "op10_sharding": op10_sharding,
}
ORACLES: dict = {"op6_kd_search": OP6_SQL, "op8_jaccard_join": OP8_SQL}
