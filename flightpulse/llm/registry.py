"""Queries of the subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from flightpulse.llm.alignment import op11_alignment
from flightpulse.llm.block_naming import OP6_SQL, op6_exact_dedup
from flightpulse.llm.fingerprints import op13_simhash
from flightpulse.llm.language import op9_language
from flightpulse.llm.mixing import OP1_SQL, op1_mix
from flightpulse.llm.near_duplicates import OP4_SQL, op4_near_dedup
from flightpulse.llm.neighbours import op7_neighbours
from flightpulse.llm.packing import op5_packing
from flightpulse.llm.quality import op2_quality
from flightpulse.llm.secrets import op10_secrets
from flightpulse.llm.token_counts import op8_token_counts
from flightpulse.llm.toxicity import op3_toxicity
from flightpulse.llm.whitening import op12_whitening

QUERIES = {
    "op1_mix": op1_mix,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_packing": op5_packing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_neighbours": op7_neighbours,
    "op8_token_counts": op8_token_counts,
    "op9_language": op9_language,
    "op10_secrets": op10_secrets,
    "op11_alignment": op11_alignment,
    "op12_whitening": op12_whitening,
    "op13_simhash": op13_simhash,
}
ORACLE_SQL = {"op1_mix": OP1_SQL, "op4_near_dedup": OP4_SQL, "op6_exact_dedup": OP6_SQL}
