"""Operators 3, 4, 8 and 9, and their statements."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from fixtures import TAKEN, clashing, corpus, frame, untouched, words
from pyspark.sql import functions as F

from tessella.llm import catalog, op3_line_dedup, op4_chat, op8_mixing, op9_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_oracle(same, name):
    same(catalog.QUERIES[name], catalog.SQL[name])


def test_native_plans_hold_no_python(spark):
    docs = frame(spark)
    chats = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    for df in (op3_line_dedup.query(spark, docs), op4_chat.query(spark, chats), op8_mixing.query(spark, docs), op9_quality_rules.query(spark, docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# quality rules


def base(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("repeat", [False, True])
def test_quality_statistics(spark, repeat):
    got = op9_quality_rules.quality_verdicts(clashing(frame(spark, repeat=repeat)), min_documents=5, max_share=0.2).collect()
    want = Counter((r[0], *base(r[1])) for r in (corpus() + corpus()[:5] if repeat else corpus()))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_quality_verdict_and_cleaning(spark):
    line = "the same boiler plate line of this host, again and again and again"
    others = ["second line that every document of it holds as well, we must say", "third line of the kind, quite as common as the two before, alas"]
    rows = [(i, "\n".join([line, *others]) + "\n" + " ".join(f"w{i}x{j}" for j in range(60)), "en", "h", 0) for i in range(20)]
    rows += [(50, "\n".join([line, *others]) + "\n" + " ".join(f"y{j}" for j in range(25)), "en", "h", 0), (51, line + "\n" + " ".join(f"z{j}" for j in range(60)), "en", "other", 0)]
    docs = frame(spark, rows)
    verdicts = {r.doc_id: r for r in op9_quality_rules.quality_verdicts(docs).collect()}
    assert not verdicts[50].base_failed and not verdicts[50].kept and verdicts[0].kept and verdicts[51].kept
    left = {r.doc_id: r for r in op9_quality_rules.clean_documents(clashing(docs)).collect()}
    assert 50 not in left and line not in left[3].text and left[51].text.startswith(line) and untouched(left.values())


def test_copies_do_not_condemn_each_other(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(5))
    docs = frame(spark, [(i, text, "en", "h", 0) for i in range(40)])
    assert all(r.kept for r in op9_quality_rules.quality_verdicts(docs).collect())
    each = op9_quality_rules.quality_verdicts(docs, equal_texts_once=False).collect()
    assert len(each) == 40 and not any(r.kept or r.base_failed for r in each)  # depleted: every line is in 40 documents


def test_the_limit_of_a_large_host_is_bounded(spark):
    line = "a line that thirty of the three hundred documents of this host hold"
    rows = [(i, (line + "\n" if i < 30 else "") + " ".join(f"w{i}x{j}" for j in range(60)), "en", "h", 0) for i in range(300)]
    lost = lambda **limits: sum(r.lost_share > 0 for r in op9_quality_rules.quality_verdicts(frame(spark, rows), max_share=0.2, **limits).collect())
    assert lost() == 0 and lost(max_documents=29) == 30 and lost(max_documents=30) == 0


# line dedup


def test_line_dedup_generalises_and_keeps_the_first(spark):
    docs = [(i, f"{name} wrote this intro here\nthis page was printed by user {name} on day {i} of the year\nlast words {'qwertyuiopas'[i]} unlike", "en", "s", 0) for i, name in enumerate("ann bob cid dan eve fay gus hal ike jon".split())]
    got = {r.doc_id: r for r in op3_line_dedup.dedup_lines(clashing(frame(spark, docs)), min_documents=5, min_fixed=0.6).collect()}
    assert all(("printed by user" in r.text) == (i == 0) for i, r in got.items())
    assert got[3].n_dropped == 1 and got[3].n_lines == 3 and untouched(got.values())
    unlike = {r.doc_id: r.n_dropped for r in op3_line_dedup.dedup_lines(frame(spark, docs), min_documents=11).collect()}
    assert not any(unlike.values())


def test_line_dedup_cuts_near_copies_like_any_other(spark):
    lines = [f"line number {'abcdefgh'[j]} of a text that has near copies" for j in range(8)]
    docs = [(i, "\n".join(lines[:i] + [f"changed here by copy {'abcdefgh'[i]} alone somehow"] + lines[i + 1 :]), "en", "s", 0) for i in range(8)]
    got = {r.doc_id: r for r in op3_line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert got[0].n_dropped == 0 and got[3].n_dropped == 8  # what differs is a field of a template, too


def test_long_lines_recur_in_two_documents(spark):
    rng = random.Random(3)
    passage, almost = (" ".join(words(rng, 60)) for _ in range(2))
    short = " ".join(words(rng, 20))
    docs = [(i, f"{passage}\n{short}\n" + " ".join(f"own{i}x{j}" for j in range(5)), "en", "s", 0) for i in (4, 2, 9)]
    docs += [(20 + i, almost.replace(almost.split()[30], f"other{'ab'[i]}"), "en", "s", 0) for i in range(2)]
    got = {r.doc_id: r for r in op3_line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert [passage in got[i].text for i in (2, 4, 9)] == [True, False, False] and all(short in got[i].text for i in (2, 4, 9))
    assert all(got[20 + i].n_dropped == 0 for i in range(2))  # alike, not the same
    assert all(r.n_dropped == 0 for r in op3_line_dedup.dedup_lines(frame(spark, docs), long_tokens=61).collect())


def test_equal_texts_count_once_or_each(spark):
    docs = [(i, "the same few words in all copies\nand another line of them", "en", "s", 0) for i in (3, 1, 5, 4, 2, 2)]
    assert {r.n_dropped for r in op3_line_dedup.dedup_lines(frame(spark, docs)).collect()} == {0}
    got = {r.doc_id: r.n_dropped for r in op3_line_dedup.dedup_lines(frame(spark, docs), equal_texts_once=False).collect()}
    assert got == {1: 0, 2: 2, 3: 2, 4: 2, 5: 2}


def test_line_dedup_defined_results(spark):
    docs = frame(spark, repeat=True)
    got = op3_line_dedup.dedup_lines(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[300].text is None and by_id[300].n_lines == 0 and by_id[301].text == ""
    shared = [r.doc_id for r in got if r.text and "all of us share" in r.text]
    assert set(shared) == {0}
    copies = {by_id[i].text for i in (9, *range(200, 208))}
    assert len(copies) == 1  # equal texts are treated alike
    assert op3_line_dedup.dedup_lines(docs.limit(0)).count() == 0


# chat


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\", "\\<|end|>", "<|turn|>x<|text|>", "<", "|>", "<\\|", "", "\n", "é中\\n", "[/INST", "[\\INST]", "<<SYS>>a<</SYS>>", "<<SYS>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)] + [(2, 0, "user", None), (2, 1, None, "x"), (3, 0, "assistant", "first"), (3, 1, "user", "tail"), (4, 5, "user", "b"), (4, 5, "user", "a"), (4, 5, "assistant", "b"), (None, 0, "assistant", "n")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in op4_chat.digests(op4_chat.prefix_target_examples(chats)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        said = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_examples(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "s")]
    got = op4_chat.prefix_target_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [r.target for r in got] == [2, 4, None] and [r.last for r in got] == [False, False, True]
    assert [r.formatted[r.loss_start : r.loss_start + r.loss_chars] for r in got[:2]] == ["a", "b"]
    assert got[1].formatted.count("<|turn|>") == 4
    assert op4_chat.prefix_target_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# mixing


def test_mixing_counts_and_shuffle(spark):
    docs = frame(spark)
    made = op8_mixing.mix(clashing(docs), {"s0": 3.0, "s1": 1.0, "s2": 1.0}, epochs=3.0)
    assert untouched(made.collect(), ["copy"]) and len(made.columns) == len(docs.columns) + len(TAKEN)
    got = op8_mixing.mix(docs, {"s0": 3.0, "s1": 1.0, "s2": 1.0}, epochs=3.0).collect()
    rate = {r["_source"]: r["rate"] for r in op8_mixing.rates(docs, {"s0": 3.0, "s1": 1.0, "s2": 1.0}, epochs=3.0).collect()}
    assert {r.source for r in got} <= set(rate)
    times = Counter(r.doc_id for r in got)
    for i, _, _, source, _ in corpus():
        if source not in rate:
            continue
        pieces, want = max(1, math.ceil(rate[source] / op8_mixing.PIECE)), 0
        lam = rate[source] / pieces
        for j in range(1, pieces + 1):
            u = int(hashlib.md5(f"{op8_mixing.SEED}:{'null' if i is None else i}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            k, p = 0, math.exp(-lam)
            c = p
            while round(c, 13) <= u:
                k += 1
                p *= lam / k
                c += p
            want += k
        assert times[i] == want
    assert [r.copy for r in got if r.doc_id == max(times, key=times.get)].__len__() == max(times.values())
    assert op8_mixing.mix(docs.limit(0)).count() == 0


def test_mixing_reaches_the_targets(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("abcdefgh").alias("text"), F.when(F.col("id") % 10 < 7, "big").otherwise("small").alias("source"))
    share = {r.source: r["count"] for r in op8_mixing.mix(docs, {"big": 1.0, "small": 1.0}).groupBy("source").count().collect()}
    assert all(abs(n - 15_000) < 600 for n in share.values())
    many = op8_mixing.mix(docs.limit(200), epochs=40.0).count()  # rates above one piece
    assert abs(many - 8000) < 400
