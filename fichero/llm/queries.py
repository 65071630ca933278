"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exponion, licences, ngram_join, tool_calls, topk, treaps
from .bpe import op6_bpe
from .classifier import op9_knn_quality
from .exponion import op11_exponion
from .html_text import op10_text_density
from .licences import op7_licence_scan
from .line_dedup import op5_line_sets
from .mixing import op1_entropy_mix
from .near_dups import op8_minhash_groups
from .ngram_join import op13_ngram_join
from .rules import op3_weak_rules
from .tool_calls import op2_tool_links
from .topk import op4_topk_impact
from .treaps import op12_treap_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_entropy_mix": op1_entropy_mix,
    "op2_tool_links": op2_tool_links,
    "op3_weak_rules": op3_weak_rules,
    "op4_topk_impact": op4_topk_impact,
    "op5_line_sets": op5_line_sets,
    "op6_bpe": op6_bpe,
    "op7_licence_scan": op7_licence_scan,
    "op8_minhash_groups": op8_minhash_groups,
    "op9_knn_quality": op9_knn_quality,
    "op10_text_density": op10_text_density,
    "op11_exponion": op11_exponion,
    "op12_treap_search": op12_treap_search,
    "op13_ngram_join": op13_ngram_join,
}
ORACLE_SQL: dict[str, str] = {
    "op2_tool_links": tool_calls.ORACLE,
    "op4_topk_impact": topk.ORACLE,
    "op7_licence_scan": licences.oracle(),
    "op11_exponion": exponion.oracle(),
    "op12_treap_search": treaps.ORACLE,
    "op13_ngram_join": ngram_join.ORACLE,
}
