"""The registered queries: operators applied to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators import counts, graph, inverted_index, joins
from ..scratch import Scratch
from ..sources import generators, readers, sinks
from ..streaming.counts import stream_term_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def counting(strategy: str):
    return lambda spark, sf_dir: counts.term_counts(_documents(spark, sf_dir), strategy=strategy)


def spaces(keep_empty: bool):
    return lambda spark, sf_dir: counts.space_counts(_documents(spark, sf_dir), keep_empty=keep_empty)


def wc_sorted(spark, sf_dir):
    return counts.term_counts(_documents(spark, sf_dir)).orderBy("term")


def wc_top_terms(spark, sf_dir):
    return counts.top_terms(_documents(spark, sf_dir), 100)


def wc_streaming(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return stream_term_counts(spark, f"{sf_dir}/documents.parque[t]", docs.schema)


def lines_containing(spark, sf_dir):
    return counts.lines_containing(_documents(spark, sf_dir), "the", "text", "doc_id")


def line_sample(spark, sf_dir):
    """A tenth of the lines, drawn by a hash of document and line number, so that any partitioning draws the same."""
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(lines(F.col("text"))).alias("line_no", "line"))
    return counts.hash_sample(rows, 0.1, "doc_id", "line_no").select("doc_id", "line_no", "line")


def inverted(spark, sf_dir):
    return inverted_index.rendered(inverted_index.postings(_documents(spark, sf_dir), "doc_id"))


def inverted_source(spark, sf_dir):
    return inverted_index.rendered(inverted_index.postings(_documents(spark, sf_dir), "source"))


def inverted_long(spark, sf_dir):
    return inverted_index.postings_long(_documents(spark, sf_dir), "doc_id")


def inverted_sorted(spark, sf_dir):
    return inverted_index.postings_sorted(_documents(spark, sf_dir), "doc_id")


def inverted_parts(spark, sf_dir):
    return inverted_index.rendered(inverted_index.postings_parts(_documents(spark, sf_dir), "doc_id", part=200))


def _customers_orders(spark, sf_dir):
    r = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return r, _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_totalprice")


def joining(strategy: str):
    return lambda spark, sf_dir: joins.equi_join(*_customers_orders(spark, sf_dir), "key", strategy)


def _nations(spark, sf_dir):
    r = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey")
    return r, _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), "c_custkey")


def join_dup_keys(spark, sf_dir):
    return joins.equi_join(*_nations(spark, sf_dir), "key", "shuffle_hash")


def _labelled(spark, sf_dir):
    """Labels, and documents, of which some have one."""
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "quality"), _documents(spark, sf_dir).select(F.col("doc_id").alias("key"), "lang", "source")


def semi_filter(spark, sf_dir):
    r, s = _labelled(spark, sf_dir)
    return joins.semi_filter(s, r, "key")


def anti_filter(spark, sf_dir):
    r, s = _labelled(spark, sf_dir)
    return joins.anti_filter(s, r, "key")


def theta(strategy: str):
    def run(spark, sf_dir):
        r = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
        return joins.theta_join(r, _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "s_acctbal", "c_acctbal", strategy)

    return run


def theta_replicated(spark, sf_dir):
    """Part sizes, of which there are few, against nation keys."""
    r = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return joins.theta_join(r, _table(spark, sf_dir, "nation").select("n_nationkey"), "p_size", "n_nationkey", "replicated")


def _parts(spark, sf_dir):
    """part -> supplier, parallel edges kept."""
    e = _table(spark, sf_dir, "lineitem")
    return e.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


def _regions(spark, sf_dir):
    e = _table(spark, sf_dir, "nation")
    return e.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))


def _cycle(spark, sf_dir):
    """customer -> nation -> supplier -> customer. A supplier has an edge to every customer of its nation; those stay unmade."""
    c, s = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    a = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    b = s.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    out = s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.col("s_nationkey").alias("via"))
    into = c.select(F.col("c_nationkey").alias("via"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    return graph.Edges(joins.union_all(a, b), out, into)


def vertices(spark, sf_dir):
    return graph.vertices(_parts(spark, sf_dir))


def vertex_count(spark, sf_dir):
    return graph.vertices(_parts(spark, sf_dir)).agg(F.count("*").alias("n"))


def out_degree(spark, sf_dir):
    return graph.out_degree(_parts(spark, sf_dir))


def adjacency(spark, sf_dir):
    return graph.adjacency(_parts(spark, sf_dir)).select("id", F.array_join("targets", ",").alias("targets"))


def dangling_mass(spark, sf_dir):
    return graph.dangling_mass(_parts(spark, sf_dir)).select(F.round("loss", 10).alias("loss"))


def _rounded(ranks: DataFrame) -> DataFrame:
    return graph.rank_order(ranks).select("id", F.round("rank", 10).alias("rank"))


def ranking(edges):
    return lambda spark, sf_dir: _rounded(graph.pagerank(edges(spark, sf_dir)))


parts_graph, regions_graph, cycle_graph = _parts, _regions, _cycle


def pagerank_simple10(spark, sf_dir):
    return _rounded(graph.pagerank_simple(_cycle(spark, sf_dir)))


def pagerank_unnormalised50(spark, sf_dir):
    edges = spark.createDataFrame([("A", "D"), ("B", "A"), ("C", "A"), ("C", "B"), ("D", "A"), ("D", "C")], "src string, dst string")
    return _rounded(graph.pagerank_unnormalised(edges))


# Text files: the tables written by the sinks and read back by the sources.


def text_lines(spark, sf_dir):
    """Lines and names: one folder for each language, as many times as a line is there."""
    place = Scratch(spark).folder("lines")
    docs = _documents(spark, sf_dir)
    sinks.write_keyed(docs.select(F.explode(lines(F.col("text")))), place)
    rows = readers.read_lines(spark, place)
    return rows.where(F.col("file").startswith("part-")).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def text_keyed(spark, sf_dir):
    """Keyed rows; customers of one segment are written as a key alone, which is no row."""
    place = Scratch(spark).folder("keyed")
    payload = F.when(F.col("c_mktsegment") != "BUILDING", F.concat_ws("\t", "c_name", "c_mktsegment"))
    sinks.write_keyed(_table(spark, sf_dir, "customer").select("c_custkey", payload), place)
    return readers.read_keyed(spark, place)


def text_relations(spark, sf_dir):
    """Two relations and another file in one directory, joined."""
    scratch = Scratch(spark)
    r, s = _customers_orders(spark, sf_dir)
    for name, df in (("customersR.dat", r), ("ordersS.dat", s.select("key", "o_orderkey")), ("readme.txt", r)):
        sinks.write_keyed(df, scratch.folder(f"both/{name}"))
    left, right = readers.read_relations(spark, scratch.folder("both"))
    return joins.equi_join(left.withColumnRenamed("payload", "c_name"), right.withColumnRenamed("payload", "o_orderkey"), "key", "shuffle_hash")


def text_edges(spark, sf_dir):
    """Edge list and back, ranked."""
    place = Scratch(spark).folder("edges")
    sinks.write_keyed(_regions(spark, sf_dir), place)
    return _rounded(graph.pagerank(readers.read_edges(spark, place)))


def text_adjacency(spark, sf_dir):
    """Adjacency lists, long ones in several lines, and back; vertices without targets have no edge."""
    place = Scratch(spark).folder("adjacency")
    sinks.write_adjacency(graph.adjacency_parts(_cycle(spark, sf_dir)), place)
    return readers.read_adjacency(spark, place)


def text_postings(spark, sf_dir):
    """Postings as text lines and back."""
    place = Scratch(spark).folder("postings")
    sinks.write_postings(inverted_index.postings(_documents(spark, sf_dir), "doc_id"), place)
    return readers.read_keyed(spark, place).select(F.col("key").alias("term"), F.col("payload").alias("postings"))


def generated_join(spark, sf_dir):
    """The generators' relations by age, joined and counted: any seed gives a row for each age that both have."""
    r, s = (generators.relation(spark, "age", side, rows) for side, rows in (("R", 1000), ("S", 10_000)))
    joined = joins.equi_join(r.withColumnRenamed("payload", "r"), s.withColumnRenamed("payload", "s"), "key", "merge")
    return joined.groupBy("key").agg(F.count("*").alias("n")).select(F.col("key").cast("int").alias("age"), (F.col("n") > 0).alias("met"))
