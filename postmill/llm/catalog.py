"""Queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

import corpus_pipeline
from postmill.llm.collocations import COLLOCATIONS_SQL, op11_collocations
from postmill.llm.jaccard import op7_jaccard_join
from postmill.llm.languages import op12_language_id
from postmill.llm.middle import FILL_IN_MIDDLE_SQL, op13_fill_in_middle
from postmill.llm.mixing import MIXING_SQL, op3_mixing
from postmill.llm.neighbours import op5_permutation_index
from postmill.llm.packing import op6_best_fit_packing
from postmill.llm.pages import op8_html_extraction
from postmill.llm.rollups import op1_token_counts
from postmill.llm.search import TOP_K_SQL, op4_top_k_search
from postmill.llm.secrets import op10_secrets
from postmill.llm.substrings import op9_substring_dedup
from postmill.llm.toxicity import op2_toxicity

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_mixing, op4_top_k_search, op5_permutation_index, op6_best_fit_packing, op7_jaccard_join, op8_html_extraction, op9_substring_dedup, op10_secrets, op11_collocations, op12_language_id, op13_fill_in_middle)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {"op3_mixing": MIXING_SQL, "op4_top_k_search": TOP_K_SQL, "op11_collocations": COLLOCATIONS_SQL, "op13_fill_in_middle": FILL_IN_MIDDLE_SQL}
