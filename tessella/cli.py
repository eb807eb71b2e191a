"""Command line: wordcount, invindex, join, theta, pagerank, generate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .operators import counts, graph, inverted_index, joins
from .session import session
from .sources import generators, readers, sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__)
    parser.add_argument("--master", default=None)
    parser.add_argument("--reducers", type=int, default=None, help="tasks of every aggregation and join, and so files of the output")
    parser.add_argument("--print", action="store_true", help="print the rows, too, in the output's order")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("wordcount")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--strategy", choices=counts.STRATEGIES, default="combine")
    p = sub.add_parser("invindex")
    p.add_argument("input")
    p.add_argument("output")
    p = sub.add_parser("join")
    p.add_argument("input", help="directory with files that end in R.dat and S.dat")
    p.add_argument("output")
    p.add_argument("--strategy", choices=joins.STRATEGIES, default="auto")
    p = sub.add_parser("theta")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--strategy", choices=joins.THETA_STRATEGIES, default="ranges")
    p = sub.add_parser("pagerank")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--factor", type=float, default=graph.DAMPING)
    p.add_argument("--max-iter", type=int, default=101)
    p.add_argument("--eps", type=float, default=1e-4)
    p.add_argument("--adjacency", action="store_true", help="lines are src:dst,dst instead of src, tab, dst")
    p = sub.add_parser("generate")
    p.add_argument("kind", choices=["course", "age"])
    p.add_argument("side", choices=["R", "S"])
    p.add_argument("output")
    p.add_argument("--rows", type=int, default=None)
    p.add_argument("--seed", type=int, default=1)
    a = parser.parse_args(argv)
    spark = session(master=a.master)
    if a.reducers:
        spark.conf.set("spark.sql.shuffle.partitions", str(a.reducers))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    show = sinks.show_keyed if a.print else lambda df: None
    if a.command == "wordcount":
        out = counts.term_counts(readers.read_lines(spark, a.input), "value", a.strategy).orderBy("term")
    elif a.command == "invindex":
        index = inverted_index.postings(readers.read_lines(spark, a.input), "file", "value")
        sinks.write_postings(index, a.output)
        show(inverted_index.rendered(index))
        return 0
    elif a.command == "join":
        r, s = readers.read_relations(spark, a.input)
        out = joins.equi_join(r.withColumnRenamed("payload", "r_payload"), s.withColumnRenamed("payload", "s_payload"), "key", a.strategy)
    elif a.command == "theta":
        r, s = (t.select(F.col("key").cast("int").alias(f"{n}_key"), F.col("payload").alias(f"{n}_payload")) for n, t in zip("rs", readers.read_relations(spark, a.input), strict=True))
        out = joins.theta_join(r, s, "r_key", "s_key", a.strategy)
    elif a.command == "pagerank":
        edges = readers.read_adjacency(spark, a.input) if a.adjacency else readers.read_edges(spark, a.input)
        timed = lambda i, distance, seconds: print(f"iteration {i}: distance {distance:.3g}, {seconds * 1000:.0f} ms", file=sys.stderr)
        out = graph.rank_order(graph.pagerank(edges, (1 - a.factor) ** 2, a.max_iter, a.eps, timed))
    else:
        out = generators.relation(spark, a.kind, a.side, a.rows, a.seed)
    sinks.write_keyed(out, a.output)
    show(out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
