"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from foliospark.llm import topk_search, url_filter
from foliospark.llm.chat_format import op2_chat_formatting
from foliospark.llm.decontamination import op1_benchmark_decontamination
from foliospark.llm.license_scan import op3_license_scan
from foliospark.llm.near_dedup import op4_minhash_near_dedup
from foliospark.llm.packing import op10_best_fit_packing
from foliospark.llm.quality import op6_quality_classifier
from foliospark.llm.sharding import op5_kd_tree_sharding
from foliospark.llm.substring_dedup import op7_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_chat_formatting,
        op3_license_scan,
        op4_minhash_near_dedup,
        op5_kd_tree_sharding,
        op6_quality_classifier,
        op7_substring_dedup,
        url_filter.op8_url_filter,
        topk_search.op9_exact_top_k_search,
        op10_best_fit_packing,
    )
}

ORACLES: dict[str, str] = {"op8_url_filter": url_filter.ORACLE, "op9_exact_top_k_search": topk_search.ORACLE}
