"""Operators 1 and 7 against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
from fixtures import clashing, corpus, frame, prose, untouched, words

from tessella.llm import op1_ngram_join as op1
from tessella.llm import op7_embedding_dedup as op7
from tessella.llm.common import Scratch
from tessella.llm.components import components


def groups(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for i in range(n):
        out[find(i)].append(i)
    return list(out.values())


def shingles(text, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def expected(rows, k, percent):
    ids = [r[0] for r in rows]
    sets = [shingles(r[1], k) for r in rows]
    linked = lambda i, j: bool(sets[i]) and ids[i] is not None and ids[j] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    comp = {}
    for own in groups(len(rows), linked):
        for i in own:
            comp[ids[i]] = min(ids[x] for x in own) if ids[i] is not None else None
    return {(i, len(s), comp[i]) for i, s in zip(ids, sets, strict=True)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 150), (150, 120), (7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 120: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_join_brute_force(spark, k, percent):
    rows = corpus()
    got = op1.similarity_components(clashing(frame(spark)), words=k, percent=percent).collect()
    assert {tuple(r) for r in got} == expected(rows, k, percent) and len(got) == len(rows)


def family(seed):
    """Documents that share most of a long passage, at all similarities around the threshold, so that hot shingles are everywhere."""
    import random

    rng = random.Random(seed)
    passage = words(rng, 80)
    rows = []
    for i in range(70):
        w = list(passage)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = f"v{i}u{rng.randrange(99)}"
        rows.append((i, " ".join(w + words(rng, rng.choice([0, 0, 2, 6]))), "en", "s", 0))
    return rows + [(500 + i, prose(rng, 100), "en", "s", 0) for i in range(10)]


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_shingles_lose_no_link(spark, seed):
    rows = family(seed)
    got = op1.similarity_components(frame(spark, rows), words=3, percent=80, hot=2, block=8, dense_block=16).collect()
    assert {tuple(r) for r in got} == expected(rows, 3, 80)


def test_dense_blocks_alone_lose_no_link(spark, monkeypatch):
    """Without early joins, everything hot goes to the block comparison."""
    monkeypatch.setattr(op1, "_early", lambda docs, *a: docs.sparkSession.createDataFrame([], "a long, b long"))
    rows = family(3)
    got = op1.similarity_components(frame(spark, rows), words=3, percent=80, hot=0, block=4, dense_block=8).collect()
    assert {tuple(r) for r in got} == expected(rows, 3, 80)


def test_common_by_ranges_and_bounded_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64) << np.uint64(55)) for n in (1, 5, 40, 80, 200, 0, 90)]
    monkeypatch.setattr(op1, "_RANGE", 16)
    apart = ~np.eye(len(sets), dtype=bool)
    assert (op1._common(sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets])[apart].all()
    monkeypatch.setattr(op1, "BLOCK_SHINGLES", 500)
    rows = family(5)
    got = op1.similarity_components(frame(spark, rows), words=3, percent=80, hot=2, block=8, dense_block=16).collect()
    assert {tuple(r) for r in got} == expected(rows, 3, 80)


def test_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    from tessella.llm import shingles as sh

    rng = __import__("random").Random(1)
    texts = [prose(rng, 400), "x" * 900, "", "a" * 300 + " b " + "c" * 500 + "\n\t d", "  ", " ".join("ab" for _ in range(300)), "tail " * 100 + "é" * 200]
    whole = sh.shingle_sets(pa.array(texts), 3)
    monkeypatch.setattr(sh, "_GROUP", 128)
    monkeypatch.setattr(sh, "_powers", [])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, sh.shingle_sets(pa.array(texts), 3), strict=True))


def test_slices_by_bytes():
    import pyarrow as pa

    from tessella.llm.batches import slices

    batch = pa.record_batch({"t": ["a" * n if n is not None else None for n in (3, 3, 50, 1, None, 0, 2, 9, 1)], "u": [None] * 8 + ["zz"]})
    parts = [p.column(0).to_pylist() for p in slices(batch, "t", "u", rows=4, size=10)]
    assert sum(parts, []) == batch.column(0).to_pylist() and [len(p) for p in parts] == [2, 1, 4, 1, 1]


def test_join_odd_inputs(spark):
    empty = frame(spark).limit(0)
    assert op1.similarity_components(empty).count() == 0
    twice = frame(spark, corpus()[:9], repeat=True)
    assert op1.similarity_components(twice).count() == 14 and op1.one_of_each(twice).count() == 9
    rows = op1.one_of_each(clashing(frame(spark))).collect()
    kept = {r.doc_id for r in rows}
    assert untouched(rows)
    assert 9 in kept and not kept & set(range(200, 208)) and None in kept


def test_one_of_each_where_an_id_has_several_texts(spark):
    x, y, z = (" ".join(f"{c}{j}" for j in range(60)) for c in "xyz")
    rows = [(5, x, "en", "s", 0), (5, y, "en", "s", 0), (2, y, "en", "s", 0), (9, x, "en", "s", 0), (7, x, "en", "s", 0), (7, z, "en", "s", 0), (7, z + " end", "en", "s", 0), (8, None, "en", "s", 0), (8, "", "en", "s", 0)]
    got = sorted((r.doc_id, r.text[0]) for r in op1.one_of_each(frame(spark, rows)).collect() if r.doc_id != 8)
    assert got == [(2, "y"), (5, "x"), (7, "z")]
    apart = [(5, x, "en", "s", 0), (5, z, "en", "s", 0), (5, z, "en", "s", 0)]
    assert sorted(r.text for r in op1.one_of_each(frame(spark, apart)).collect()) == [x, z]


def vectors(seed=0, n=300, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for c in range(6):
        x[c * 20 + 1 : c * 20 + 15] = x[c * 20] + rng.normal(size=(14, dims)) * rng.choice([0.05, 0.15, 0.25])
    x[250:255] = x[249]
    return x.astype(np.float32)


def test_embeddings_brute_force(spark):
    x = vectors()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    odd = [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [1.0, None] * 8, "x"), (904, [float("inf")] + [0.0] * 15, "x"), (905, [1.0, 2.0], "x"), (None, x[7].tolist(), "x"), (249, x[249].tolist(), "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, cid string")
    for lists, probes, block in ((16, 16, 1024), (16, 16, 7)):
        got = op7.near_duplicates(df, lists=lists, probes=probes, block=block).collect()
        assert len(got) == 308
        by = {r.vec_id: r for r in got if r.vec_id is not None}
        comp = {i: min(g) for g in groups(300, lambda i, j: near[i, j]) for i in g}
        for i in range(300):
            extra = int(near[i, 7]) + int(near[i, 249])  # the row without an id and the repeated one
            assert (by[i].n_links, by[i].component_id, by[i].kept) == (near[i].sum() - 1 + extra, comp[i], comp[i] == i), i
        assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in range(900, 906))


def test_embeddings_recall_with_few_probes(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1200, 32))
    x = np.concatenate([base, base[:600] + rng.normal(size=(600, 32)) * 0.2]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    true = int((unit @ unit.T >= 0.95).sum()) - len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = sum(r.n_links for r in op7.near_duplicates(df).collect())
    assert true > 500 and 0.9 * true <= found <= true


def test_embeddings_of_several_lengths(spark):
    x, y = vectors(1, 300, 16)[:200], vectors(2, 300, 24)[:150, :8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(y)] + [(5000, [1.0, 2.0, 3.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op7.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lists=8, probes=8).collect()}
    assert len(got) == 351 and got[5000] == (0, 5000)
    for base, own in ((0, x), (1000, y)):
        unit = own.astype(float) / np.linalg.norm(own.astype(float), axis=1)[:, None]
        near = unit @ unit.T >= 0.95
        assert near.sum() > len(own) + 100
        comp = {i: min(g) for g in groups(len(own), lambda i, j, near=near: near[i, j]) for i in g}
        assert all(got[base + i] == (near[i].sum() - 1, base + comp[i]) for i in range(len(own)))


def test_skipped_lists_hold_no_link():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 12))
    x = op7._unit(np.concatenate([base, base + rng.normal(size=base.shape) * 0.08])).astype(np.float32)
    q = op7.Quantiser(x, 40)
    near, may = q.lists(x, 40, op7._reach(0.95))
    own, allowed = near[:, 0], [set(n[m].tolist()) for n, m in zip(near, may, strict=True)]
    i, j = np.nonzero(x.astype(float) @ x.T.astype(float) >= 0.95)
    assert len(i) > 1000 and all(own[b] in allowed[a] for a, b in zip(i, j, strict=True)) and may.mean() < 0.9


def test_centres_within_clusters(monkeypatch):
    monkeypatch.setattr(op7, "_FLAT", 8)
    x = np.random.default_rng(3).normal(size=(500, 6)).astype(np.float32)
    centres = op7._centres(x, 49, 1)
    assert 40 <= len(centres) <= 56 and np.isfinite(centres).all()
    assert op7._nearest(x, centres).min(axis=1).mean() < op7._nearest(x, op7._kmeans(x, 4, 8, 1)).min(axis=1).mean()


def test_embeddings_empty(spark):
    assert op7.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    alone = op7.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first()
    assert tuple(alone) == (1, 0, 1, True)
