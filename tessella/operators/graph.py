"""Vertex sets, adjacency and link analysis over an edge table (src, dst), or over ``Edges`` of which some go through groups."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .joins import PAIRS, equi_join

DAMPING = 0.15
#: Targets in a part of a vertex's adjacency.
PART = 100_000


@dataclass(frozen=True)
class Edges:
    """The edges ``plain`` (src, dst), and one for each pair of rows of ``out`` (src, via) and ``into`` (via, dst) with equal
    ``via``. Those are as many as the product of the sizes of a group, and are never made by degrees and ranks."""

    plain: DataFrame
    out: DataFrame
    into: DataFrame

    @classmethod
    def of(cls, edges: DataFrame | Edges) -> Edges:
        """``edges`` with both sides of groups reduced to what makes edges."""
        if isinstance(edges, cls):
            return cls(edges.plain, edges.out.join(edges.into.select("via").distinct(), "via", "left_semi"), edges.into.join(edges.out.select("via").distinct(), "via", "left_semi"))
        none = edges.limit(0)
        return cls(edges, none.select("src", F.lit(0).alias("via")), none.select(F.lit(0).alias("via"), "dst"))

    @property
    def session(self) -> SparkSession:
        return self.plain.sparkSession


def _sources(edges: Edges) -> DataFrame:
    return edges.plain.select(F.col("src").alias("id")).union(edges.out.select("src")).distinct()


def _degrees(edges: Edges) -> DataFrame:
    """(src, d) of vertices with out-edges."""
    sizes = edges.into.groupBy("via").agg(F.count("*").alias("d"))
    through = edges.out.groupBy("src", "via").agg(F.count("*").alias("m")).join(sizes, "via").select("src", (F.col("m") * F.col("d")).alias("d"))
    plain = edges.plain.groupBy("src").agg(F.count("*").alias("d"))
    return plain.unionByName(through).groupBy("src").agg(F.sum("d").alias("d"))


def vertices(edges: DataFrame | Edges) -> DataFrame:
    if isinstance(edges, DataFrame):
        return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    edges = Edges.of(edges)
    return vertices(edges.plain).union(edges.out.select("src")).union(edges.into.select("dst")).distinct()


def out_degree(edges: DataFrame | Edges) -> DataFrame:
    """(id, out_degree) of every vertex; parallel edges count each, sinks have 0."""
    if isinstance(edges, DataFrame):
        counted = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    else:
        counted = _degrees(Edges.of(edges)).withColumnRenamed("src", "id")
    return vertices(edges).join(counted, "id", "left").select("id", F.coalesce("d", F.lit(0)).cast("long").alias("out_degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, targets): targets in ascending order, parallel edges kept, sinks with none."""
    listed = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("t"))
    kind = f"array<{edges.schema['dst'].dataType.simpleString()}>"
    return vertices(edges).join(listed, "id", "left").select("id", F.coalesce("t", F.array().cast(kind)).alias("targets"))


def adjacency_parts(edges: DataFrame | Edges, part: int = PART) -> DataFrame:
    """(id, targets) as ``adjacency`` has them, but a vertex's targets in as many rows as parts of about ``part`` take, so
    that no vertex has to fit in a row or a task, and the targets of a group are listed once for all its sources."""
    edges = Edges.of(edges)

    def listed(pairs: DataFrame, by: str) -> DataFrame:
        parts = pairs.groupBy(by).agg(F.ceil(F.count("*") / part).alias("parts")).where("parts > 1")
        place = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1)))
        dealt = pairs.join(parts, by, "left").select(by, "dst", place.alias("part"))
        return dealt.groupBy(by, "part").agg(F.sort_array(F.collect_list("dst")).alias("targets")).drop("part")

    plain = listed(edges.plain, "src").withColumnRenamed("src", "id")
    through = equi_join(edges.out, listed(edges.into, "via"), "via", "shuffle_hash", max(1, PAIRS // part)).select(F.col("src").alias("id"), "targets")
    sinks = vertices(edges).join(_sources(edges), "id", "left_anti").select("id", F.array().cast(plain.schema["targets"].dataType).alias("targets"))
    return plain.unionByName(through).unionByName(sinks)


class _Links:
    """The share of a vertex's rank that each edge carries, parallel edges merged; through a group the shares are summed
    first, then given to every member, so a step costs as much as the tables, not as the edges."""

    def __init__(self, edges: DataFrame | Edges):
        self.grouped, edges = isinstance(edges, Edges), Edges.of(edges)
        degree = _degrees(edges) if self.grouped else edges.plain.groupBy("src").agg(F.count("*").alias("d"))
        weight = (F.col("m") / F.col("d")).alias("weight")
        plain = edges.plain.groupBy("src", "dst").agg(F.count("*").alias("m")).join(degree, "src").select("src", "dst", weight)
        self.tables = [plain.persist()]
        if self.grouped:
            self.tables.append(edges.out.groupBy("src", "via").agg(F.count("*").alias("m")).join(degree, "src").select("src", "via", weight).persist())
            self.tables.append(edges.into.persist())

    def got(self, ranks: DataFrame) -> DataFrame:
        """(dst, got): what each vertex with in-edges receives of ``ranks`` (id, rank)."""
        links, *groups = self.tables
        share = F.col("rank") * F.col("weight")
        shares = ranks.join(links, ranks["id"] == links["src"]).select("dst", share.alias("got"))
        if groups:
            out, into = groups
            sums = ranks.join(out, ranks["id"] == out["src"]).groupBy("via").agg(F.sum(share).alias("got"))
            shares = shares.unionByName(into.join(sums, "via").select("dst", "got"))
        return shares.groupBy("dst").agg(F.sum("got").alias("got"))

    def unpersist(self) -> None:
        for t in self.tables:
            t.unpersist()


def dangling_mass(edges: DataFrame | Edges, f: float = DAMPING) -> DataFrame:
    """One row: the rank that a first damped step from uniform ranks loses at sinks."""
    sinks = out_degree(edges).agg((F.sum(F.when(F.col("out_degree") == 0, 1).otherwise(0)) / F.count("*")).alias("share"))
    return sinks.select(((1 - f) * F.col("share")).alias("loss"))


def pagerank(edges: DataFrame | Edges, damping: float = (1 - DAMPING) ** 2, max_iter: int = 101, eps: float = 1e-4, told_of: Callable[[int, float, float], None] | None = None) -> DataFrame:
    """(id, rank) by power iteration with the rank of sinks spread over all vertices, until the squared distance of
    two iterations is under ``eps``.

    Damping a step by 1 - f, then again when the lost rank is handed out, is one step with damping (1 - f) ** 2; that is
    the default. An iteration is one join with the constant links (and one more through groups) and one written table, whose read yields the distance
    and the next sink mass. ``told_of`` gets the number of each iteration, its distance and its seconds.
    """
    scratch = Scratch(edges.sparkSession if isinstance(edges, DataFrame) else edges.session)
    links = _Links(edges)
    nodes = out_degree(edges).select("id", (F.col("out_degree") == 0).alias("sink")).persist()
    try:
        first = nodes.agg(F.count("*").alias("n"), F.sum(F.col("sink").cast("int")).alias("sinks")).first()
        n = first["n"]
        if not n:
            return nodes.select("id", F.lit(0.0).alias("rank"))
        ranks, lost = nodes.select("id", "sink", F.lit(1.0 / n).alias("rank")), first["sinks"] / n
        step = None
        for i in range(max_iter):
            began = time.perf_counter()
            got = links.got(ranks)
            new = damping * (F.coalesce("got", F.lit(0.0)) + lost / n) + (1 - damping) / n
            before, step = step, scratch.keep(ranks.join(got, ranks["id"] == got["dst"], "left").select("id", "sink", new.alias("rank"), F.col("rank").alias("old")))
            told = step.agg(F.sum(F.pow(F.col("rank") - F.col("old"), 2)).alias("distance"), F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("lost")).first()
            ranks, lost = step.drop("old"), told["lost"]
            if before is not None:
                scratch.free(before)
            if told_of:
                told_of(i + 1, told["distance"], time.perf_counter() - began)
            if told["distance"] < eps:
                break
        return scratch.keep(nodes.select("id", F.lit(1.0 / n).alias("rank"))) if step is None else ranks.select("id", "rank")
    finally:
        links.unpersist()
        nodes.unpersist()


def rank_order(ranks: DataFrame) -> DataFrame:
    """Highest rank first, equal ranks by id descending."""
    return ranks.orderBy(F.desc("rank"), F.desc("id"))


def _rounds(edges: Edges, links: _Links, ranks: DataFrame, rounds: int, base: float, keep: float) -> DataFrame:
    scratch = Scratch(edges.session)
    every = 1 if links.grouped else 5  # through groups a round reads the ranks twice
    for i in range(rounds):
        ranks = links.got(ranks).select(F.col("dst").alias("id"), (base + keep * F.col("got")).alias("rank"))
        if i % every == every - 1 or i == rounds - 1:
            ranks = scratch.keep(ranks)
            scratch.only(ranks)
    links.unpersist()
    return ranks


def pagerank_simple(edges: DataFrame | Edges, rounds: int = 10) -> DataFrame:
    """Fixed rounds of 0.15/n + 0.85 * incoming, n being the vertices with out-edges; vertices without in-edges drop out."""
    links, edges = _Links(edges), Edges.of(edges)
    sources = _sources(edges)
    n = sources.count()
    return _rounds(edges, links, sources.select("id", F.lit(1.0 / max(n, 1)).alias("rank")), rounds, 0.15 / max(n, 1), 0.85)


def pagerank_unnormalised(edges: DataFrame | Edges, rounds: int = 50) -> DataFrame:
    """Fixed rounds of 0.15 + 0.85 * incoming from rank 1."""
    links, edges = _Links(edges), Edges.of(edges)
    return _rounds(edges, links, _sources(edges).select("id", F.lit(1.0).alias("rank")), rounds, 0.15, 0.85)
