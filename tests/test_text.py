import pytest
from pyspark.sql import functions as F

from tessella.functions.text import space_terms, whitespace_terms
from tessella.operators import counts, inverted_index

CASES = [("", [], [""]), (" ", [], []), (" a", ["a"], ["", "a"]), ("a  b ", ["a", "b"], ["a", "", "b"]), ("a\tb", ["a", "b"], ["a\tb"]), ("a\x0bb", ["a\x0bb"], ["a\x0bb"])]


@pytest.mark.parametrize("text,white,space", CASES)
def test_tokenisers(spark, text, white, space):
    row = spark.createDataFrame([(text,)], "t string").select(whitespace_terms(F.col("t")).alias("w"), space_terms(F.col("t")).alias("s")).first()
    assert row["w"] == white and row["s"] == space


@pytest.mark.parametrize("strategy", counts.STRATEGIES)
def test_strategies_agree(spark, strategy):
    docs = spark.createDataFrame([("a b\na c|d", 1), (None, 2), ("", 3), (" a:x  a ", 4)], "text string, id int")
    got = {r["term"]: r["cnt"] for r in counts.term_counts(docs, strategy=strategy).collect()}
    assert got == {"a": 4 - 1, "b": 1, "c|d": 1, "a:x": 1}


def test_partial_aggregation_is_planned(spark):
    docs = spark.createDataFrame([("a",)], "text string")
    plan = counts.term_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1


def test_postings(spark):
    docs = spark.createDataFrame([("d2", "x y|z"), ("d10", "x x\nx"), ("d2", "x"), ("d3", None)], "doc string, text string")
    got = {r["term"]: r["postings"] for r in inverted_index.rendered(inverted_index.postings(docs, "doc")).collect()}
    assert got == {"x": "d10:3,d2:2", "y|z": "d2:1"}
    assert inverted_index.postings(docs.limit(0), "doc").count() == 0


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        counts.term_counts(spark.createDataFrame([("a",)], "text string"), strategy="x")


def test_parts_hold_each_posting_once(spark):
    docs = spark.createDataFrame([(f"d{i}", "x y" if i % 50 else "x x z") for i in range(500)], "doc string, text string")
    rows = inverted_index.postings_parts(docs, "doc", part=20).collect()
    by = {t: [p for r in rows if r["term"] == t for p in r["postings"]] for t in "xyz"}
    assert {t: len(p) for t, p in by.items()} == {"x": 500, "y": 490, "z": 10}
    assert len({p["doc"] for p in by["x"]}) == 500 and max(len(r["postings"]) for r in rows) < 45 and len([r for r in rows if r["term"] == "z"]) == 1


def test_sorted_postings_split_a_common_term(spark):
    docs = spark.createDataFrame([(f"d{i:04}", "x") for i in range(3000)], "doc string, text string")
    df = inverted_index.postings_sorted(docs, "doc")
    assert "rangepartitioning(term" in df._jdf.queryExecution().executedPlan().toString()
    assert [r["doc"] for r in df.collect()] == [f"d{i:04}" for i in range(3000)]


def test_line_counts_stay_in_their_row(spark):
    plan = counts.term_counts(spark.createDataFrame([("a",)], "text string"), strategy="per_line")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_postings_of_documents_of_one_row_are_not_dealt(spark):
    docs = spark.createDataFrame([("d1", "x y x"), ("d2", "x"), (None, None), ("d3", "")], "doc string, text string")
    df = inverted_index.postings_long(docs, "doc")
    assert sorted(map(tuple, df.collect())) == [("x", "d1", 2), ("x", "d2", 1), ("y", "d1", 1)]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_postings_of_documents_of_several_rows_are_added(spark):
    for rows in ([("d1", "x y"), ("d2", "x"), ("d1", "x"), (None, "x"), (None, "z x")], [("d1", "x"), ("d1", "x y")]):
        docs, want = spark.createDataFrame(rows, "doc string, text string"), {}
        for d, t in rows:
            for term in t.split():
                want[term, d] = want.get((term, d), 0) + 1
        assert {(r["term"], r["doc"]): r["tf"] for r in inverted_index.postings_long(docs, "doc").collect()} == want


def test_parts_take_one_exchange(spark):
    docs = spark.createDataFrame([(f"d{i}", "x y") for i in range(50)], "doc string, text string")
    plan = inverted_index.postings_parts(docs, "doc", part=20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
