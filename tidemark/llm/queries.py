"""The corpus queries and their DuckDB SQL, by name."""

from __future__ import annotations

from .fingerprint import op1_weighted_fingerprints
from .langid import op2_nearest_centroid_langid
from .lexical import OP12_SQL, op12_geometric_block_search
from .linedup import op3_fuzzy_line_dedup
from .mixing import OP7_SQL, op7_pareto_mix
from .ngramjoin import op4_ngram_jaccard_join
from .packing import op5_best_fit_packing
from .phrases import OP11_SQL, op11_de_bruijn_phrases
from .preference import op13_bradley_terry_quality
from .quality import OP10_SQL, op10_line_first_quality
from .secrets import op8_secret_ownership
from .toxicity import op6_factorization_toxicity
from .warc import OP9_SQL, op9_warc_round_trip

QUERIES = {
    "op1_weighted_fingerprints": op1_weighted_fingerprints,
    "op2_nearest_centroid_langid": op2_nearest_centroid_langid,
    "op3_fuzzy_line_dedup": op3_fuzzy_line_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_factorization_toxicity": op6_factorization_toxicity,
    "op7_pareto_mix": op7_pareto_mix,
    "op8_secret_ownership": op8_secret_ownership,
    "op9_warc_round_trip": op9_warc_round_trip,
    "op10_line_first_quality": op10_line_first_quality,
    "op11_de_bruijn_phrases": op11_de_bruijn_phrases,
    "op12_geometric_block_search": op12_geometric_block_search,
    "op13_bradley_terry_quality": op13_bradley_terry_quality,
}

ORACLES = {
    "op7_pareto_mix": OP7_SQL,
    "op9_warc_round_trip": OP9_SQL,
    "op10_line_first_quality": OP10_SQL,
    "op11_de_bruijn_phrases": OP11_SQL,
    "op12_geometric_block_search": OP12_SQL,
}
