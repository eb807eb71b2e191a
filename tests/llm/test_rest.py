"""Operators 2, 5, 6 and 10, and the pipeline."""

import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import TAKEN, clashing, corpus, frame, untouched, words
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import op1_ngram_join, op2_packing, op3_line_dedup, op5_html, op6_quality_classifier, op8_mixing, op9_quality_rules, op10_sharding
from tessella.llm.common import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op2_packing.vocabulary_path())


# packing


def check_packing(pieces, texts, tokenizer, length):
    """Every document whole, sequences gapless and within length; returns the number of sequences."""
    want = Counter()
    for i, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for p, s in enumerate(range(0, len(ids), length)):
            want[i, p, s, len(ids[s : s + length]), zlib.crc32(ids[s : s + length].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length
    return len(bins)


@pytest.mark.parametrize("length,ranked", [(4096, 1_000_000), (300, 2)])
def test_packing(spark, tokenizer, monkeypatch, length, ranked):
    monkeypatch.setattr(op2_packing, "RANKED", ranked)
    docs = frame(spark, repeat=True)
    got = op2_packing.pack_documents(clashing(docs), length=length).collect()
    bins = check_packing(got, [(r[0], r[1]) for r in corpus() + corpus()[:5]], tokenizer, length)
    rooms = []  # first-fit decreasing
    for size in sorted((r.length for r in got), reverse=True):
        k = next((i for i, room in enumerate(rooms) if room >= size), None)
        if k is None:
            rooms.append(length - size)
        else:
            rooms[k] -= size
    assert bins <= len(rooms)
    assert op2_packing.pack_documents(docs.limit(0)).count() == 0


def test_ids_come_along(spark, tokenizer):
    got = op2_packing.pack_documents(frame(spark, corpus()[:3]), length=50, include_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)


def test_sequences_hold_the_documents(spark, tokenizer):
    rows = [r for r in corpus()[:20] if r[0] is not None]
    placed = op2_packing.pack_documents(frame(spark, rows), length=200, include_ids=True)
    assert set(op2_packing.pack_documents(frame(spark, rows), length=200).columns) | {"ids"} == set(placed.columns)
    whole = {r.sequence_id: r for r in op2_packing.sequences(placed).collect()}
    assert all(len(r.ids) == sum(r.lengths) <= 200 for r in whole.values())
    by = defaultdict(list)
    for r in placed.collect():
        assert whole[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids
        by[r.doc_id].append((r.piece, r.ids))
    for r in rows:
        assert sum((ids for _, ids in sorted(by[r[0]])), []) == [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]


def test_word_lookup_is_exact(tokenizer):
    texts = ["don't it's we'll rock'n'roll", "É́ x", "a<|endoftext|>b", "ΣΑΣ οδός İ ǅ", "x²y 10,000.5 a_b ___ ...''", "\x1cab\x85cd ef", "ﬁ ŀ ß µ Å STRASSE", "中文 字。", "a\x00b \x7f ​z", "Word, word! WORD??", "", " "]
    got = op2_packing.Encoder(op2_packing.vocabulary_path()).encode(texts)
    assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_words_beyond_those_remembered(tokenizer, monkeypatch):
    monkeypatch.setattr(op2_packing, "_REMEMBERED", 5)
    encoder, rng = op2_packing.Encoder(op2_packing.vocabulary_path()), random.Random(7)
    for _ in range(20):
        texts = [None, *("".join(rng.choice("abÀß '.,!-_<|>09²\u0301\u2028\n\x1c中é") for _ in range(rng.randint(0, 50))) for _ in range(50))]
        assert encoder.encode(texts) == [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert len(encoder.known) <= 5 and encoder.encode([]) == []


def test_local_search_empties_bins():
    # Best fit decreasing needs a bin more than exchanges do.
    bins = op2_packing._improve([[6, 3], [5, 4], [1, 1]], 10)
    assert len(bins) == 2 and sorted(sum(bins, [])) == [1, 1, 3, 4, 5, 6]
    swapped = op2_packing._improve([[5, 4], [6, 2], [3]], 10)
    assert len(swapped) == 2 and all(sum(b) <= 10 for b in swapped)
    counts = Counter(np.random.default_rng(0).integers(1, 1000, 5000).tolist())
    patterns = op2_packing.plan(dict(counts), 1000)
    placed = Counter()
    for bin_, n in patterns:
        assert sum(s * k for s, k in bin_.items()) <= 1000
        placed.update({s: k * n for s, k in bin_.items()})
    assert placed == counts


def improvable(one, other, length):
    """Whether a piece of ``one`` against none, one or two of ``other`` increases the sum of squared fills."""
    a, b = sum(one), sum(other)
    given = [0, *other, *(s + t for i, s in enumerate(other) for t in other[i + 1 :])]
    return any(x > y and b + x - y <= length and b + x - y > a for x in set(one) for y in given)


@pytest.mark.parametrize("low,high,n,length", [(17, 33, 9000, 100), (5, 60, 700, 97), (3, 12, 4000, 25)])
def test_local_search_covers_all_bins(low, high, n, length):
    counts = Counter(np.random.default_rng(low).integers(low, high, n).tolist())
    patterns = op2_packing.plan(dict(counts), length)
    placed = Counter()
    for bin_, k in patterns:
        placed.update({s: c * k for s, c in bin_.items()})
    assert placed == counts
    bins = [([s for s, c in bin_.items() for _ in range(c)], k) for bin_, k in patterns]
    if sum(k for _, k in bins) > op2_packing.least(counts, length):  # no exchange is left between any two bins
        assert not any(improvable(a, b, length) for i, (a, k) in enumerate(bins) for j, (b, _) in enumerate(bins) if i != j or k > 1)


def test_local_search_beyond_a_few_hundred_bins():
    counts = Counter(np.random.default_rng(4).integers(700, 1300, 20_000).tolist())
    started = sum(n for _, n in op2_packing.best_fit(counts, 4096))
    assert sum(n for _, n in op2_packing.plan(counts, 4096)) < 0.96 * started
    assert op2_packing.least({51: 3, 50: 2, 49: 3, 2: 1}, 100) == 5 and op2_packing.least({10: 21}, 100) == 3


# html


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<p>a &amp b<p>c&nbsp;&lt;d&gt; &am", "a & b c <d> &am"),
        ("<body><nav>Menu</nav><div class='ad'>Buy now, today.</div><article><h1>T</h1><p><b>One <br><p>two<p>x</article><footer>f", "T One two x"),
        ("<article><p>ok</p><div class='comments'><p>first! nice, really nice.</p></div><form>mail</form><aside>x</aside></article>", "ok"),
        ("<div class=\"cookie-notice\">We use cookies, please. Thanks.</div><div id=content><h1>Head</h1><p>Long text, with points. And more; yes.</p><p>s</p></div><div class='sidebar'><p>links, here. and there.</p></div>", "Head Long text, with points. And more; yes. s"),
        ("<script>var t='<p>no</p>';</script><style>p{}</style><main><p>yes<!-- no --></p><p>a < b</p></main>", "yes a < b"),
        ("<div><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div><p>Body of the text, here. It goes on, and on.</p></div>", "Body of the text, here. It goes on, and on."),
        ("<article><p>Text.</p><ol class=commentlist><li>First, I say!</li></ol><div id=newsletterBox>Join us.</div></article>", "Text."),
        ("<article>un<b>brok</b>en <a href='x>y'>link</a></article>", "unbroken link"),
        ("<div class='with-sidebar'><article><p>inside</p></article></div>", "inside"),
    ],
)
def test_main_text(page, text):
    assert op5_html.main_text(page) == text


@pytest.mark.parametrize("n", [1, 40])
def test_title_and_lead_stay_however_long_the_body(n):
    body = "".join(f"<p>A paragraph of the body, number {i}; it goes on, and on.</p>" for i in range(n))
    said = " ".join(f"A paragraph of the body, number {i}; it goes on, and on." for i in range(n))
    assert op5_html.main_text(f"<div id=content><h1>T</h1><p>lead</p><div>{body}</div></div><div><a href=x>One</a></div>") == f"T lead {said}"
    other = "<article><p>Other, short.</p></article>" if n > 1 else ""
    assert op5_html.main_text(f"<main><h1>T</h1><article>{body}</article>{other}</main>") == f"T {said}"


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in op5_html.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", body)).split()
        assert got[r.page_id].text == " ".join(want) and got[r.page_id].n_chars == len(got[r.page_id].text)
    assert op5_html.extract(pages.limit(0)).count() == 0


def test_scores_choose_the_text(monkeypatch, spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    want = [op5_html.main_text(p) for p in pages]
    plain = [op5_html.main_text(re.sub(r"<(/?)(article|nav|header|footer|aside|form)\b", r"<\1div", p)) for p in pages]
    assert sum(a == b for a, b in zip(want, plain, strict=True)) >= 0.9 * len(pages)  # without elements that say what they are
    rng = random.Random(0)
    with monkeypatch.context() as m:
        m.setattr(op5_html, "_scores", lambda blocks: [rng.random() for _ in blocks])
        assert sum(op5_html.main_text(p) != t for p, t in zip(pages, want, strict=True)) >= 0.9 * len(pages)


def test_scores_are_the_ratios_of_tag_paths():
    page = "<body><div><h2>Head</h2><p>One, two. <b>Three</b></p><p>Four; <a href=x>five</a>!</p></div><ul><li><a href=y>Six</a></ul><div class=ad>Seven.</div></body>"
    got = {" ".join("".join(b.texts).split()): s for b, s in zip(op5_html.read_blocks(page), op5_html._scores(op5_html.read_blocks(page)), strict=True)}
    # By path: characters outside links and punctuation marks, for each block.
    texts, marks = [4.0, (14 + 6) / 2, (14 + 6) / 2], [0.0, 2.0, 2.0]
    smooth = lambda v: [(v[0] + 0.6 * v[1] + 0.2 * v[2]) / 1.8, (0.6 * v[0] + v[1] + 0.6 * v[2]) / 2.2, (0.2 * v[0] + 0.6 * v[1] + v[2]) / 1.8]
    fused = [t * (1 + m) for t, m in zip(smooth(texts), smooth(marks), strict=True)]
    assert got["Head"] == pytest.approx(fused[0])
    assert got["One, two. Three"] == got["Four; five!"] == pytest.approx((fused[1] + fused[2]) / 2)
    assert got["Six"] == got["Seven."] == 0


def test_menus_and_adverts_without_names_go():
    body = "".join(f"<p>Paragraph {i} of the text, which says something; it goes on, and on.</p>" for i in range(6))
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(6)) + "</ul></div>"
    page = f"<body>{menu}<div>Buy this now.</div><div><h1>T</h1>{body}<ul><li>x</li><li>y</li></ul></div><div>All rights reserved.</div></body>"
    got = op5_html.main_text(page)
    assert got.startswith("T Paragraph 0") and got.endswith("x y") and "Part" not in got and "rights" not in got and "Buy" not in got


@pytest.mark.parametrize("page", ["<span>" * 3000 + "x</q>" * 3000, "<div>" * 12000 + "x", "<h1>" * 6000 + "<br>x" * 6000, "<q><div>" + "<span>" * 6000 + "x</q>" * 6000, "<a x='>y" * 6000, "<table><tr>" + "<td>x" * 6000, "<ul>" + "<li><a>x" * 6000, "<table><tr><td>" * 4000 + "x"])
def test_hard_pages_take_linear_time(page):
    began = time.perf_counter()
    op5_html.main_text(page)
    assert time.perf_counter() - began < 2


# classifier


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in op6_quality_classifier.query(spark, docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.97


def test_classifier_odd_inputs(spark):
    docs = frame(spark, repeat=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = op6_quality_classifier.score(clashing(docs), op6_quality_classifier.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(np.isfinite(r.score) for r in rows)
    none = op6_quality_classifier.query(spark, docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.7}
    assert op6_quality_classifier.query(spark, docs.limit(0), labels).count() == 0


def test_fit_minimises_the_pairwise_loss():
    rng = np.random.default_rng(5)
    x = rng.random((400, 5))
    label = (x @ [3.0, -2.0, 0.5, 0, 1] + rng.normal(size=400) * 0.5 > 1.2).astype(int)
    model = op6_quality_classifier.Ranking.fit(x, label, pairs=3000, seed=9)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    draw = np.random.default_rng(9)
    d = x[good[draw.integers(len(good), size=3000)]] - x[bad[draw.integers(len(bad), size=3000)]]
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + op6_quality_classifier.RIDGE / 2 * w @ w
    w = np.zeros(5)
    for _ in range(20_000):  # plain gradient descent
        w -= 4.0 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + op6_quality_classifier.RIDGE * w)
    assert loss(model.weights) <= loss(w) + 1e-7 and np.abs(model.weights - w).max() < 0.05 * np.abs(w).max()
    below = (x @ model.weights < model.cutoff).mean()
    assert abs(below - (label == 0).mean()) < 0.01  # the cutoff is the quantile at the share of label 0


def labelled(spark, n):
    """Documents, labels and, for the training rows, statistics and labels."""
    rng = random.Random(n)
    rows = [(i, " ".join(rng.choice(["the", "model", "of", "10", "||", "#x", "Cat."]) for _ in range(rng.randint(0, 12)))) for i in range(n)]
    marks = [(i, int(t.count("|") + rng.randint(0, 6) < 5)) for i, t in rows]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    own = [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2]
    return docs, labels, op6_quality_classifier.features(pa.array([rows[i][1] for i in own])), np.array([marks[i][1] for i in own])


def test_fit_takes_all_pairs(spark):
    docs, labels, x, label = labelled(spark, 900)
    model = op6_quality_classifier.train(docs, labels)
    d = (x[label == 1][:, None] - x[label == 0][None]).reshape(-1, x.shape[1])
    slope = -(d / (1 + np.exp(d @ model.weights))[:, None]).mean(axis=0) + op6_quality_classifier.RIDGE * model.weights
    assert len(d) > 50_000 and np.abs(slope).max() < 1e-8
    share, u = (label == 0).mean(), x @ model.weights
    assert abs(model.cutoff - np.quantile(u, [share - 0.002, share + 0.002]).mean()) < 1e-9


def test_fit_takes_all_labelled_rows(spark):
    docs, labels, x, label = labelled(spark, 32_000)
    assert len(x) > 23_000
    model, want = op6_quality_classifier.train(docs, labels), op6_quality_classifier.Ranking.fit(x, label)
    assert np.abs(model.weights - want.weights).max() < 1e-6 and abs(model.cutoff - want.cutoff) < 1e-6


def test_pairwise_sums_are_those_of_all_pairs():
    rng = np.random.default_rng(2)
    x, label = rng.random((120, 4)), np.arange(120) % 3 % 2
    d = (x[label == 1][:, None] - x[label == 0][None]).reshape(-1, 4)
    for scale in (0, 1, 30):
        w, sums = rng.normal(size=4) * scale, {}
        op6_quality_classifier._add_moments(sums, x[:50], label[:50], w)
        op6_quality_classifier._add_moments(sums, x[50:], label[50:], w)
        value, slope, curve = op6_quality_classifier._all_pairs_loss(sums, 4)
        p = 1 / (1 + np.exp(d @ w))
        assert abs(value - np.logaddexp(0, -d @ w).mean()) < 1e-11
        assert np.abs(slope + (d * p[:, None]).mean(axis=0)).max() < 1e-11 and np.abs(curve - (d * (p * (1 - p))[:, None]).T @ d / len(d)).max() < 1e-11


def test_strengths_of_given_ranks_are_exact(spark):
    values = [-3.5, -0.0, 0.0, 1e-300, -1e-300, 2.0, 2.0, 2.0, 7e9, -7e9, 0.1, 0.3]
    rows = spark.createDataFrame([(i % 2, [v]) for i, v in enumerate(values)], "label int, x array<double>")
    got = [op6_quality_classifier._ranked(rows, np.ones(1), [k, k + 1]) for k in range(len(values) - 1)]
    assert got == [[a, b] for a, b in zip(sorted(values), sorted(values)[1:], strict=False)]


# sharding


@pytest.mark.parametrize("large,bucket_rows", [(4096, 2000), (8, 10)])
def test_shards(spark, large, bucket_rows):
    rows = corpus()
    got = op10_sharding.shard_assignments(clashing(frame(spark, repeat=True)), large=large, bucket_rows=bucket_rows).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows + rows[:5])
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for k in range(8):
        own = sorted(r.slot for r in got if r.shard == k)
        assert own == list(range(len(own)))


def test_groups_go_where_the_dot_product_is_highest(spark):
    """Against a plain loop over the groups of a table that is one bucket with no large group."""
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randint(1, 90))), "en", "s", 0) for i in range(1500)]
    rows += [(2000 + i, rows[i % 300][1], "en", "s", 0) for i in range(400)]
    got = op10_sharding.shard_assignments(frame(spark, rows), large=10, exchange=False).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r[0])
    vectors = {t: ((len(t.encode()) + 1) * len(i), len(t.split()) * len(i), len(i)) for t, i in groups.items()}
    total = [sum(v[m] for v in vectors.values()) for m in range(3)]
    residual, where = [[1 / 8] * 3 for _ in range(8)], {}
    for t in sorted(vectors, key=lambda t: -vectors[t][0]):
        share = [v / n for v, n in zip(vectors[t], total, strict=True)]
        dots = [8 * share[0] * r[0] + share[1] * r[1] + share[2] * r[2] for r in residual]
        where[t] = dots.index(max(dots))
        residual[where[t]] = [r - s for r, s in zip(residual[where[t]], share, strict=True)]
    by_id = {r.doc_id: r.shard for r in got}
    assert all(len({by_id[i] for i in ids}) == 1 for ids in groups.values())  # groups stay whole
    load = lambda find: sorted(tuple(sum(v[m] for t, v in vectors.items() if find(t) == k) for m in range(3)) for k in range(8))
    for a, b in zip(load(lambda t: by_id[groups[t][0]]), load(where.get), strict=True):
        assert a == pytest.approx(b, rel=0.02)  # groups of equal size may change places
    loads = [x[0] for x in load(lambda t: by_id[groups[t][0]])]
    assert max(loads) <= 1.02 * min(loads)


def test_placement_is_the_rule_itself():
    rng = np.random.default_rng(1)
    vectors, capacity = rng.integers(1, 500, (200, 3)).astype(float), rng.integers(5000, 9000, (5, 3)).astype(float)
    got, scale, residual = op10_sharding.place(vectors, capacity, 2), capacity.sum(axis=0), capacity / capacity.sum(axis=0)
    for i in sorted(range(200), key=lambda i: (-vectors[i, 0], i)):
        dots = [sum(w * v / s * r for w, v, s, r in zip((8, 1, 1), vectors[i], scale, residual[k], strict=True)) for k in range(5)]
        assert dots[got[i]] == pytest.approx(max(dots), rel=1e-9)
        residual[got[i]] -= vectors[i] / scale


def test_shards_are_balanced_and_hot_groups_split(spark):
    rows = [(i, f"text {i} " + "x" * (i * 37 % 400), "en", "s", 0) for i in range(3000)] + [(5000 + i, "hot copy " * 20, "en", "s", 0) for i in range(1500)]
    got = op10_sharding.shard_assignments(frame(spark, rows)).collect()
    sizes = [sum(r["size"] for r in got if r.shard == k) for k in range(8)]
    assert max(sizes) <= 1.01 * min(sizes)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) <= 1.2 * min(counts.values())


def test_many_short_or_null_texts_are_split(spark):
    rows = [(i, f"text {i} " + "x" * (i * 37 % 400), "en", "s", 0) for i in range(3000)] + [(5000 + i, None, "en", "s", 0) for i in range(1500)]
    rows += [(None, None, "en", "s", 0)] * 500  # equal in all columns
    got = op10_sharding.shard_assignments(frame(spark, rows), bucket_rows=80).collect()
    counts = Counter(r.shard for r in got)
    assert len(counts) == 8 and max(counts.values()) <= 1.2 * min(counts.values())
    assert max(Counter(r.bucket for r in got).values()) <= 2 * len(got) / 62  # what one task ranks


def test_write_shards(spark, tmp_path):
    docs = frame(spark, [r for r in corpus() if r[0] is not None])
    op10_sharding.write_shards(clashing(docs), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == docs.count() and untouched(rows, ["shard"])
    assert op10_sharding.shard_assignments(docs.limit(0)).count() == 0


# pipeline


def test_pipeline_stage_by_stage(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    one = stages["quality rules"](spark, docs, SF).cache()
    verdicts = {r.doc_id: r.kept for r in op9_quality_rules.query(spark, docs).collect()}
    assert {r.doc_id for r in one.collect()} == {i for i, k in verdicts.items() if k} and one.columns == docs.columns
    two = stages["line dedup"](spark, one, SF).cache()
    lines = {r.doc_id: r.text for r in op3_line_dedup.dedup_lines(one).collect()}
    assert {r.doc_id: r.text for r in two.collect()} == {i: t for i, t in lines.items() if t.strip()} and all(r.n_chars == len(r.text) for r in two.collect())
    three = stages["n-gram Jaccard join"](spark, two, SF).cache()
    firsts = {r.component_id for r in op1_ngram_join.similarity_components(two).collect()}
    assert {r.doc_id for r in three.collect()} == firsts and three.columns == docs.columns
    four = stages["mixing sources to target weights"](spark, three, SF).cache()
    assert Counter(r.doc_id for r in four.collect()) == Counter(r.doc_id for r in op8_mixing.mix(three).collect()) and four.columns == docs.columns
    five = stages["best-fit packing"](spark, four, SF).collect()
    check_packing(five, [(r.doc_id, r.text) for r in four.collect()], tokenizer, 4096)
    whole = corpus_pipeline.run(spark, SF)
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in five)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, whole.select(*key).collect())) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in five)
    assert whole.agg(F.countDistinct("sequence_id")).first()[0] <= len({r.sequence_id for r in five}) + 1


def test_pipeline_on_odd_documents(spark):
    docs = frame(spark, repeat=True)
    docs, kept = clashing(docs), Scratch(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept.keep(stage(spark, docs, SF))
        rows = docs.collect()
        assert rows and untouched(rows) and set(docs.columns) >= set(TAKEN)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    none = frame(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = kept.keep(stage(spark, none, SF))
    assert none.count() == 0


def test_pipeline_drops_a_passage_whatever_its_share(spark):
    """Line dedup is operator 3 for every document; exact copies keep their lines for the join."""
    rng = random.Random(4)
    passage, *lines = (" ".join(words(rng, n)) for n in (60, *[10] * 20))
    rows = [(i, passage + "\n" + " ".join(f"own{i}x{j}" for j in range(70 if i % 3 == 0 else 50 if i % 3 == 1 else 20)), "en", f"s{i % 7}", 0) for i in range(30)]
    rows += [(100 + i, "\n".join(lines), "en", "s0", 0) for i in range(10)]
    stages = dict(corpus_pipeline.STAGES)
    whole, two = {r[0]: r[1] for r in rows}, stages["line dedup"](spark, frame(spark, rows), SF).cache()
    got = {r.doc_id: r.text for r in two.collect()}
    assert [i for i, t in got.items() if passage in t] == [0]
    assert all(got[i] == whole[i].split("\n")[1] for i in range(1, 30)) and all(got[i] == whole[i] for i in range(100, 110))
    three = {r.doc_id for r in stages["n-gram Jaccard join"](spark, two, SF).collect()}
    assert three == {*range(30), 100}
