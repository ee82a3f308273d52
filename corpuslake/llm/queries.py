"""The contract queries of the training-data operators and their SQL."""

from __future__ import annotations

from corpuslake.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from corpuslake.llm.language import op10_language_id
from corpuslake.llm.mixing import OP5_SQL, op5_source_mixing
from corpuslake.llm.packing import op2_best_fit_packing
from corpuslake.llm.quality import op9_quality
from corpuslake.llm.simhash import op1_simhash
from corpuslake.llm.substring_dedup import op3_substring_dedup
from corpuslake.llm.token_store import op4_token_store
from corpuslake.llm.toxicity import op7_toxicity
from corpuslake.llm.vectors import OP6_SQL, op6_near_vectors

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_store": op4_token_store,
    "op5_source_mixing": op5_source_mixing,
    "op6_near_vectors": op6_near_vectors,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL = {"op5_source_mixing": OP5_SQL, "op6_near_vectors": OP6_SQL, "op8_exact_dedup": OP8_SQL}
