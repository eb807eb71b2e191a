"""Small documents with the awkward cases: nulls, empty, blank and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo ya".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def prose(rng, n):
    w = words(rng, n)
    return "".join(x + (".\n" if i % 17 == 16 else " ") for i, x in enumerate(w)).strip()


def corpus(seed=0, n=60):
    """(id, text, lang, source, n_chars) rows: prose, exact and near copies, a shared line, a shared passage, and odd texts."""
    rng = random.Random(seed)
    rows = []
    shared, passage = "all of us share this very line here", " ".join(words(rng, 55))
    for i in range(n):
        text = prose(rng, rng.randint(60, 260))
        if i % 4 == 0:
            text += "\n" + shared
        if i % 5 == 0:
            text += "\n" + passage
        rows.append([i, text, "en", f"s{i % 3 if i % 2 else 0}"])
    base = rows[7][1].split(" ")
    for j in range(12):  # near copies: one word changed
        w = list(base)
        w[(j * 7) % len(w)] = f"changed{j}"
        rows.append([100 + j, " ".join(w), "en", "s0"])
    rows += [[200 + j, rows[9][1], "en", f"s{j % 3}"] for j in range(8)]  # exact copies
    rows += [[300, None, None, None], [301, "", "en", "s1"], [302, " \n\t ", "en", "s1"], [303, "one", "en", "s2"], [304, "two words", "en", None], [305, "One", "fr", "s2"], [306, "a b c a b c a b c " * 30, "en", "s2"], [307, prose(rng, 9000), "de", "s0"], [None, rows[3][1], "en", "s1"], [308, "###$$$ *** <b>| 1 2 3 &&& %%%", "en", "s1"], [309, "x\\y </s> [INST] é中 " + "z" * 5000, "en", "s2"]]
    return [(r[0], r[1], r[2], r[3], len(r[1] or "")) for r in rows]


def frame(spark, rows=None, repeat=False):
    rows = corpus() if rows is None else rows
    return spark.createDataFrame(rows + rows[:5] if repeat else rows, DOCS).repartition(3)


TAKEN = (
    "n_words kept shard length component_id copy rate score token size words line n_shingles row drop left content_a content_b host bad share base windows symbols dup_lines "
    "key times order pieces cdf _source many i l label item fixed bucket at offset first parts sid k0 k1 rep block _chunk _rank piece start vector cid list codes error probes id h2 l2 rhost "
    "rcontent_a _drop d_a d_b _content_a _content_b _left _pieces _cdf _times _order _bad _host _base _words _share _text _at _gone_doc_id _many_label first_content_a leaf template whole documents normal"
).split()


def clashing(df):
    """With columns whose names the operators use inside, or have used."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in TAKEN if c not in df.columns])


def untouched(rows, but=()):
    """Whether those columns came through by value."""
    return all(r[c] == f"own {c}" for r in rows for c in TAKEN if c not in but)
