import pytest

from tessella.operators import graph

EDGES = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "a"), ("c", "c"), ("d", "a"), ("b", "e")]


def two_step(edges, f=0.15, eps=1e-4, cap=101):
    ids = sorted({x for e in edges for x in e})
    n, out = len(ids), {v: [b for a, b in edges if a == v] for v in ids}
    rank = dict.fromkeys(ids, 1 / n)
    for _ in range(cap):
        got = dict.fromkeys(ids, 0.0)
        for v in ids:
            for t in out[v]:
                got[t] += rank[v] / len(out[v])
        x = {v: (1 - f) * got[v] + f / n for v in ids}
        loss = 1 - sum(x.values())
        new = {v: (1 - f) * (x[v] + loss / n) + f / n for v in ids}
        distance, rank = sum((new[v] - rank[v]) ** 2 for v in ids), new
        if distance < eps:
            break
    return rank


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string")


def test_closed_form_is_two_damped_steps(edges):
    got = {r["id"]: r["rank"] for r in graph.pagerank(edges).collect()}
    assert got == pytest.approx(two_step(EDGES), abs=1e-12) and sum(got.values()) == pytest.approx(1)


def test_order_and_limits(edges):
    ranked = [tuple(r) for r in graph.rank_order(graph.pagerank(edges, eps=0.0, max_iter=3)).collect()]
    assert ranked == sorted(ranked, key=lambda r: (r[1], r[0]), reverse=True)
    assert dict(ranked) == pytest.approx(two_step(EDGES, eps=0.0, cap=3), abs=1e-12)


def test_structure(edges, spark):
    assert {r["id"]: r["out_degree"] for r in graph.out_degree(edges).collect()} == {"a": 3, "b": 2, "c": 1, "d": 1, "e": 0}
    assert {r["id"]: r["targets"] for r in graph.adjacency(edges).collect()} == {"a": ["b", "b", "c"], "b": ["a", "e"], "c": ["c"], "d": ["a"], "e": []}
    assert graph.dangling_mass(edges).first()["loss"] == pytest.approx(0.85 / 5)
    empty = spark.createDataFrame([], "src string, dst string")
    assert graph.pagerank(empty).count() == 0 and graph.vertices(empty).count() == 0


def test_literal_graph_drops_nothing(spark):
    e = spark.createDataFrame([("A", "D"), ("B", "A"), ("C", "A"), ("C", "B"), ("D", "A"), ("D", "C")], "src string, dst string")
    ranks = {r["id"]: r["rank"] for r in graph.pagerank_unnormalised(e, 20).collect()}
    assert set(ranks) == set("ABCD") and sum(ranks.values()) == pytest.approx(4, abs=1e-6)


def grouped(spark):
    """Edges of which some go through groups, and the same edges made; groups 3 and 4 have one side only, and a null makes none."""
    plain = spark.createDataFrame([("a", "b"), ("b", "x"), ("x", "c"), ("x", "c"), ("y", "a")], "src string, dst string")
    out = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("y", 2), ("a", 2), ("z", 3), ("c", None)], "src string, via int")
    into = spark.createDataFrame([(1, "b"), (1, "c"), (1, "c"), (2, "y"), (2, "c"), (4, "w"), (None, "b")], "via int, dst string")
    return graph.Edges(plain, out, into), plain.union(out.join(into, "via").select("src", "dst"))


def test_edges_through_groups_rank_as_if_made(spark):
    edges, made = grouped(spark)
    ranked = lambda df: {r["id"]: r["rank"] for r in df.collect()}
    assert ranked(graph.pagerank(edges)) == pytest.approx(two_step([tuple(r) for r in made.collect()]), abs=1e-12)
    for ranks in (graph.pagerank_simple, graph.pagerank_unnormalised):
        assert ranked(ranks(edges, 4)) == pytest.approx(ranked(ranks(made, 4)), abs=1e-12)
    assert sorted(map(tuple, graph.out_degree(edges).collect())) == sorted(map(tuple, graph.out_degree(made).collect()))
    assert graph.dangling_mass(edges).first()["loss"] == pytest.approx(graph.dangling_mass(made).first()["loss"])


def test_cycle_leaves_edges_of_groups_unmade(spark, sf_dir):
    from tessella.plans import queries

    edges = queries.cycle_graph(spark, sf_dir)
    assert isinstance(edges, graph.Edges) and edges.plain.count() == sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("customer", "supplier"))


def test_adjacency_in_parts(spark, tmp_path):
    from tessella.sources import readers, sinks

    edges, made = grouped(spark)
    want = sorted(map(tuple, made.collect()))
    for part in (1, 2, 100):
        rows = graph.adjacency_parts(edges, part).collect()
        assert sorted((r["id"], t) for r in rows for t in r["targets"]) == want and {r["id"] for r in rows} == {r["id"] for r in graph.vertices(made).collect()}
    assert len(rows) > len({r["id"] for r in rows}) and all(r["targets"] == sorted(r["targets"]) for r in rows)
    sinks.write_adjacency(graph.adjacency_parts(edges, 2), str(tmp_path / "a"))
    assert sorted(map(tuple, readers.read_adjacency(spark, str(tmp_path / "a")).collect())) == want


def test_lines_are_taken_apart_before_their_targets(spark, tmp_path):
    from tessella.sources import readers

    (tmp_path / "a").write_text("a:b,c\n")
    plan = readers.read_adjacency(spark, str(tmp_path / "a"))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "split(" not in above and "split(value" in below
