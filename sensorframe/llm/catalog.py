"""Queries of the training-data operators and their SQL, for the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_byte_bpe
from .embeddings import op3_pca_tiles
from .filter_audit import OP12_SQL, op12_filter_audit
from .fingerprints import op1_lz_fingerprints
from .jaccard_join import op7_prefix_jaccard
from .line_dedup import op9_edit_lines
from .passages import op5_paragraph_minhash
from .mixing import op4_mix_sources
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op10_quality
from .sharding import op6_ring_shards
from .topk_search import OP11_SQL, op11_max_score
from .url_lists import OP2_SQL, op2_temporal_lists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lz_fingerprints": op1_lz_fingerprints,
    "op2_temporal_lists": op2_temporal_lists,
    "op3_pca_tiles": op3_pca_tiles,
    "op4_mix_sources": op4_mix_sources,
    "op5_paragraph_minhash": op5_paragraph_minhash,
    "op6_ring_shards": op6_ring_shards,
    "op7_prefix_jaccard": op7_prefix_jaccard,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_edit_lines": op9_edit_lines,
    "op10_quality": op10_quality,
    "op11_max_score": op11_max_score,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL: dict[str, str] = {
    "op2_temporal_lists": OP2_SQL,
    "op11_max_score": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
