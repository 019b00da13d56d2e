"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import op01_sharding, op04_mixing, op09_debruijn
from . import op11_filter_audit as op11
from . import op12_fill_in_middle as op12
from .op01_sharding import op1_extendible_hash_shards
from .op02_forest import op2_hash_prefix_forest
from .op03_surrogates import op3_pii_surrogates
from .op04_mixing import op4_weighted_fair_queue_mix
from .op05_urls import op5_path_template_tree
from .op06_quality import op6_knn_quality
from .op07_bpe import op7_bpe_encode
from .op08_simhash import op8_simhash_near_dedup
from .op09_debruijn import op9_debruijn_span_dedup
from .op10_order_minhash import op10_order_minhash
from .op11_filter_audit import op11_filter_audit
from .op12_fill_in_middle import op12_fill_in_middle
from .op13_html import op13_site_template_removal

QUERIES = {f.__name__: f for f in (op1_extendible_hash_shards, op2_hash_prefix_forest, op3_pii_surrogates, op4_weighted_fair_queue_mix, op5_path_template_tree, op6_knn_quality, op7_bpe_encode, op8_simhash_near_dedup, op9_debruijn_span_dedup, op10_order_minhash, op11_filter_audit, op12_fill_in_middle, op13_site_template_removal)}

ORACLE_SQL: dict[str, str] = {
    "op1_extendible_hash_shards": op01_sharding.ORACLE,
    "op4_weighted_fair_queue_mix": op04_mixing.ORACLE,
    "op9_debruijn_span_dedup": op09_debruijn.ORACLE,
    "op11_filter_audit": op11.ORACLE,
    "op12_fill_in_middle": op12.ORACLE,
}
