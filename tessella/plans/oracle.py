"""DuckDB statements with the results of the registered queries."""

from __future__ import annotations

_TERMS = "SELECT {keep}unnest(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS term FROM documents"
_COUNT = f"SELECT term, count(*) AS cnt FROM ({_TERMS.format(keep='')}) GROUP BY term"
_LINES = "SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line FROM documents"
_NUMBERED = "SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) - 1 AS line_no FROM documents"
_UNIFORM = f"(CAST('0x' || substr(md5({{key}}), 1, 13) AS BIGINT) / CAST({2**52} AS DOUBLE))"
_SPACES = f"""SELECT term, count(*) AS cnt FROM (SELECT unnest(CASE WHEN line = '' THEN [''] WHEN rtrim(line, ' ') = '' THEN [] ELSE string_split(rtrim(line, ' '), ' ') END) AS term
FROM ({_LINES})) {{where}} GROUP BY term"""


def _postings(doc: str) -> str:
    return f"""SELECT term, string_agg(doc || ':' || tf, ',' ORDER BY doc) AS postings FROM
(SELECT term, doc, count(*) AS tf FROM ({_TERMS.format(keep=f"CAST({doc} AS VARCHAR) AS doc, ")}) GROUP BY term, doc) GROUP BY term"""


_POSTINGS_LONG = f"SELECT term, doc, count(*) AS tf FROM ({_TERMS.format(keep='CAST(doc_id AS VARCHAR) AS doc, ')}) GROUP BY term, doc"
_JOIN = "SELECT c_custkey AS key, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey"
_THETA = "SELECT s_suppkey, s_acctbal, c_custkey, c_acctbal FROM supplier JOIN customer ON s_acctbal > c_acctbal"
_PARTS = "SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem"
_REGIONS = "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation"
_CYCLE = """SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
UNION ALL SELECT 's' || s_suppkey, 'c' || c_custkey FROM customer JOIN supplier ON c_nationkey = s_nationkey"""
_NODES = "SELECT src AS id FROM edges UNION SELECT dst FROM edges"


def _pagerank(edges: str, f: float = 0.15, eps: float = 1e-4, cap: int = 101) -> str:
    """Two damped steps per iteration, as published, so that the closed form is tested."""
    return f"""
WITH RECURSIVE edges AS ({edges}), nodes AS ({_NODES}), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes),
degree AS (SELECT src, count(*) AS d FROM edges GROUP BY src),
links AS (SELECT e.src, e.dst, CAST(count(*) AS DOUBLE) / any_value(d.d) AS w FROM edges e JOIN degree d ON e.src = d.src GROUP BY e.src, e.dst),
walk(i, id, rank, dist) AS (
  SELECT 0, id, 1.0 / n.n, CAST(1.0 AS DOUBLE) FROM nodes, n
  UNION ALL
  SELECT i + 1, id, new, sum((new - old) * (new - old)) OVER () FROM (
    SELECT i, id, old, (1 - {f}) * (x + (1 - sum(x) OVER ()) / n.n) + {f} / n.n AS new FROM (
      SELECT w.i, w.id, w.rank AS old, (1 - {f}) * coalesce(g.got, 0) + {f} / n.n AS x
      FROM walk w CROSS JOIN n LEFT JOIN (SELECT l.dst, sum(p.rank * l.w) AS got FROM walk p JOIN links l ON p.id = l.src GROUP BY l.dst) g ON w.id = g.dst
      WHERE w.dist >= {eps} AND w.i < {cap}), n))
SELECT id, round(rank, 10) AS rank FROM walk WHERE i = (SELECT max(i) FROM walk)
"""


def _rounds(edges: str, rounds: int, base: str, first: str, keep: float = 0.85) -> str:
    """Fixed rounds over vertices with out-edges; those that nothing reaches drop out."""
    return f"""
WITH RECURSIVE edges AS ({edges}), sources AS (SELECT DISTINCT src AS id FROM edges), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM sources),
degree AS (SELECT src, count(*) AS d FROM edges GROUP BY src),
links AS (SELECT e.src, e.dst, CAST(count(*) AS DOUBLE) / any_value(d.d) AS w FROM edges e JOIN degree d ON e.src = d.src GROUP BY e.src, e.dst),
walk(i, id, rank) AS (
  SELECT 0, id, CAST({first} AS DOUBLE) FROM sources, n
  UNION ALL
  SELECT any_value(p.i) + 1, l.dst, any_value({base}) + {keep} * sum(p.rank * l.w) FROM walk p JOIN links l ON p.id = l.src, n WHERE p.i < {rounds} GROUP BY l.dst)
SELECT id, round(rank, 10) AS rank FROM walk WHERE i = {rounds}
"""


SQL: dict[str, str] = {
    **dict.fromkeys(("wc_whitespace", "wc_shuffle_first", "wc_line_preagg", "wc_partition_preagg", "wc_sorted", "wc_streaming"), _COUNT),
    "wc_space_split": _SPACES.format(where="WHERE term <> ''"),
    "wc_space_split_empty": _SPACES.format(where=""),
    "wc_top_terms": _COUNT + " ORDER BY cnt DESC, term LIMIT 100",
    "lines_containing": f"SELECT doc_id, line FROM ({_LINES}) WHERE contains(line, 'the')",
    "inverted_index": _postings("doc_id"),
    "inverted_index_source": _postings("source"),
    "line_sample": f"SELECT doc_id, line_no, line FROM ({_NUMBERED}) WHERE {_UNIFORM.format(key="doc_id || ':' || line_no")} < 0.1",
    "inverted_index_parts": f"""SELECT term, CAST(floor({_UNIFORM.format(key='doc')} * ceil(df / 200.0)) AS INT) AS part, string_agg(doc || ':' || tf, ',' ORDER BY doc) AS postings
FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM ({_POSTINGS_LONG})) GROUP BY 1, 2""",
    "text_lines": f"SELECT line, count(*) AS n FROM ({_LINES}) GROUP BY line",
    "text_keyed": "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || chr(9) || c_mktsegment AS payload FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "text_relations": "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey",
    "text_edges": _pagerank(_REGIONS),
    "text_adjacency": _CYCLE,
    "text_postings": _postings("doc_id"),
    "generated_join": "SELECT CAST(age AS INT) AS age, true AS met FROM range(100) AS t(age)",
    **dict.fromkeys(("inverted_index_long", "inverted_index_sorted"), _POSTINGS_LONG),
    **dict.fromkeys(("join_repartition", "join_merge", "join_broadcast", "join_semi_reduced", "join_auto"), _JOIN),
    "join_dup_keys": "SELECT s_nationkey AS key, s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey",
    "semi_filter": "SELECT doc_id AS key, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "anti_filter": "SELECT doc_id AS key, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    **dict.fromkeys(("theta_gt", "theta_gt_ranges"), _THETA),
    "theta_gt_replicated": "SELECT p_partkey, p_size, n_nationkey FROM part JOIN nation ON p_size > n_nationkey",
    "vertices": f"WITH edges AS ({_PARTS}) {_NODES}",
    "vertex_count": f"WITH edges AS ({_PARTS}) SELECT count(*) AS n FROM ({_NODES})",
    "out_degree": f"WITH edges AS ({_PARTS}) SELECT v.id, count(e.src) AS out_degree FROM ({_NODES}) v LEFT JOIN edges e ON v.id = e.src GROUP BY v.id",
    "adjacency": f"WITH edges AS ({_PARTS}) SELECT v.id, coalesce(string_agg(e.dst, ',' ORDER BY e.dst), '') AS targets FROM ({_NODES}) v LEFT JOIN edges e ON v.id = e.src GROUP BY v.id",
    "dangling_mass": f"""WITH edges AS ({_PARTS}), nodes AS ({_NODES}), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes),
degree AS (SELECT src, count(*) AS d FROM edges GROUP BY src),
got AS (SELECT e.dst, sum(1.0 / n.n / d.d) AS g FROM edges e JOIN degree d ON e.src = d.src CROSS JOIN n GROUP BY e.dst)
SELECT round(1 - sum(0.85 * coalesce(g, 0) + 0.15 / n.n), 10) AS loss FROM nodes LEFT JOIN got ON id = dst CROSS JOIN n""",
    "pagerank_part_supplier": _pagerank(_PARTS),
    "pagerank_nation_region": _pagerank(_REGIONS),
    "pagerank_cycle": _pagerank(_CYCLE),
    "pagerank_simple10": _rounds(_CYCLE, 10, "0.15 / n.n", "1.0 / n.n"),
    "pagerank_unnormalised50": _rounds("SELECT * FROM (VALUES ('A', 'D'), ('B', 'A'), ('C', 'A'), ('C', 'B'), ('D', 'A'), ('D', 'C')) AS t(src, dst)", 50, "0.15", "1.0"),
}
