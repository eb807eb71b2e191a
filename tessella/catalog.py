"""Query name -> callable, and query name -> DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries as q
from .plans.oracle import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "wc_whitespace": q.counting("combine"),
    "wc_shuffle_first": q.counting("shuffle_first"),
    "wc_line_preagg": q.counting("per_line"),
    "wc_partition_preagg": q.counting("per_partition"),
    "wc_space_split": q.spaces(False),
    "wc_space_split_empty": q.spaces(True),
    "wc_sorted": q.wc_sorted,
    "wc_top_terms": q.wc_top_terms,
    "wc_streaming": q.wc_streaming,
    "lines_containing": q.lines_containing,
    "line_sample": q.line_sample,
    "inverted_index": q.inverted,
    "inverted_index_source": q.inverted_source,
    "inverted_index_long": q.inverted_long,
    "inverted_index_sorted": q.inverted_sorted,
    "inverted_index_parts": q.inverted_parts,
    "join_repartition": q.joining("shuffle_hash"),
    "join_merge": q.joining("merge"),
    "join_broadcast": q.joining("broadcast"),
    "join_semi_reduced": q.joining("semi_reduced"),
    "join_auto": q.joining("auto"),
    "join_dup_keys": q.join_dup_keys,
    "semi_filter": q.semi_filter,
    "anti_filter": q.anti_filter,
    "theta_gt": q.theta("nested_loop"),
    "theta_gt_ranges": q.theta("ranges"),
    "theta_gt_replicated": q.theta_replicated,
    "vertices": q.vertices,
    "vertex_count": q.vertex_count,
    "out_degree": q.out_degree,
    "adjacency": q.adjacency,
    "dangling_mass": q.dangling_mass,
    "pagerank_part_supplier": q.ranking(q.parts_graph),
    "pagerank_nation_region": q.ranking(q.regions_graph),
    "pagerank_cycle": q.ranking(q.cycle_graph),
    "pagerank_simple10": q.pagerank_simple10,
    "pagerank_unnormalised50": q.pagerank_unnormalised50,
    "text_lines": q.text_lines,
    "text_keyed": q.text_keyed,
    "text_relations": q.text_relations,
    "text_edges": q.text_edges,
    "text_adjacency": q.text_adjacency,
    "text_postings": q.text_postings,
    "generated_join": q.generated_join,
}
