"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .ball_kmeans import OP12_SQL, op12_ball_kmeans
from .decontaminate import op1_decontamination
from .lattice_lm import op8_lattice_lm
from .licenses import op5_license_scan
from .ngram_join import op2_ngram_jaccard_join
from .packing import op3_best_fit_packing
from .quality import OP4_SQL, op4_quality_rules
from .suffix_dedup import op10_suffix_dedup
from .token_counts import op7_token_counts
from .token_files import op6_token_files
from .urls import op9_url_filter
from .whitening import op11_embedding_whitening
from .window_cuts import op13_window_cuts

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scan": op5_license_scan,
    "op6_token_files": op6_token_files,
    "op7_token_counts": op7_token_counts,
    "op8_lattice_lm": op8_lattice_lm,
    "op9_url_filter": op9_url_filter,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_window_cuts": op13_window_cuts,
}

ORACLE_SQL: dict[str, str] = {"op4_quality_rules": OP4_SQL, "op12_ball_kmeans": OP12_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
