"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .jaccard import op2_bayesian_jaccard
from .mixing import op8_subset_sum_mix
from .packing import op1_best_fit_packing
from .pages import op7_tree_model_text
from .quality import OP4_SQL, op4_host_rules
from .repeats import op6_repeated_passages
from .resampling import OP12_SQL, op12_target_resampling
from .sharding import op3_sampled_splitters
from .simhash import op13_simhash_tiles
from .token_files import op5_token_files
from .topk import OP9_SQL, op9_histogram_topk
from .toxicity import op10_ftrl_toxicity
from .whitening import op11_tiled_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_bayesian_jaccard": op2_bayesian_jaccard,
    "op3_sampled_splitters": op3_sampled_splitters,
    "op4_host_rules": op4_host_rules,
    "op5_token_files": op5_token_files,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_tree_model_text": op7_tree_model_text,
    "op8_subset_sum_mix": op8_subset_sum_mix,
    "op9_histogram_topk": op9_histogram_topk,
    "op10_ftrl_toxicity": op10_ftrl_toxicity,
    "op11_tiled_whitening": op11_tiled_whitening,
    "op12_target_resampling": op12_target_resampling,
    "op13_simhash_tiles": op13_simhash_tiles,
}

SQL: dict[str, str] = {"op4_host_rules": OP4_SQL, "op9_histogram_topk": OP9_SQL, "op12_target_resampling": OP12_SQL}
