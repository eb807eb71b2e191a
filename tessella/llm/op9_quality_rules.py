"""Quality rules: text statistics and cross-document line frequency per host.

Base rules look at one document. The cross-document rule normalises every line
(lower case, white space collapsed, ends trimmed), hashes it, and counts the
distinct documents of a host that hold it. Lines above the limit are removed
from every document of the host, and a document that loses most of its words
is rejected as depleted.

Defined results
- null text: as the empty text, all counts 0, base_failed; null host: a host of its own.
- documents of equal text count once per host, so copies of a good document do
  not condemn each other (removing copies is another operator's work). With
  ``equal_texts_once`` false every (id, text) counts.
- repeated rows: each comes back, with the same verdict.
- empty table: no rows. Extra columns: ``clean_documents`` keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if, content_key, let, nested, once, unnested, words_of

#: Production limits.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line goes beyond ``MAX_SHARE`` of its host's documents, but not in ``MIN_DOCUMENTS`` or fewer, and always beyond ``MAX_DOCUMENTS``.
MIN_DOCUMENTS = 10
MAX_SHARE = 0.05
MAX_DOCUMENTS = 1000
MAX_LOST = 0.5
#: Documents with removable lines that may be broadcast; about 100 bytes each.
BROADCAST_ROWS = 200_000
#: Lines above the limit that may be broadcast; about 30 bytes each.
BROADCAST_LINES = 500_000

SYMBOLS = r"[^#*$%&|<>]+"
KEY = ["host", "content_a", "content_b"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _covered(positions: Column) -> Column:
    """Words covered by 3-word windows that start at these ascending positions."""
    steps = F.transform(positions, lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get(positions, i - 1))))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def _repeated(windows: Column, doubles: Column) -> Column:
    """Covered words. Few different doubles are looked up for each window; many are found by sorting the windows with their positions."""
    few = let(
        F.filter(F.transform(windows, lambda h, i: F.when(F.array_contains(doubles, h), i)), lambda p: p.isNotNull()), _covered
    )

    def neighbours(pairs: Column) -> Column:
        alike = F.filter(pairs, lambda x, i: (x["h"] == F.get(pairs, i - 1)["h"]) | (x["h"] == F.get(pairs, i + 1)["h"]) & (i + 1 < F.size(pairs)))
        return F.sort_array(F.transform(alike, lambda x: x["p"]))

    many = let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), lambda s: let(neighbours(s), _covered))
    return F.when(F.size(doubles) == 0, 0).when(F.size(doubles) <= 24, few).otherwise(many)


def _measured(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The columns ``keep`` and a struct ``base`` of the per-document counts."""
    w, s = F.col("words"), F.col("windows")
    lines = F.filter(_lines(text), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(*keep, words_of(text).alias("words"), F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SYMBOLS, "")).alias("symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("dup_lines"))
    hashed = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    step = step.withColumn("windows", F.slice(hashed, 1, F.greatest(F.size(w) - 2, F.lit(0))))
    unlike = F.size(F.array_distinct(s)) == F.size(s)
    doubles = let(F.sort_array(s), lambda o: F.array_distinct(F.filter(o, lambda h, i: (i > 0) & (h == F.get(o, i - 1)))))
    counts = [
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"),
        F.col("dup_lines").cast("long").alias("n_dup_lines"),
        F.when(unlike, 0).otherwise(let(doubles, lambda d: _repeated(s, d))).cast("long").alias("n_repeat_words"),
    ]
    # A filter on the counts, pushed below them, would split the text again for each of its words.
    return step.select(*keep, once(F.struct(*counts)).alias("base"))


def _keys(docs: DataFrame, text: str, host: str, doc_id: str, equal_texts_once: bool) -> dict[str, Column]:
    content = content_key(F.col(text)) if equal_texts_once else content_key(F.col(text), F.col(doc_id))
    return dict(zip(KEY, [F.col(host), *content], strict=True))


def _host_lines(docs: DataFrame, text: str, keys: dict[str, Column]) -> DataFrame:
    """Distinct (host, line hash, document content) of lines with a word."""
    hashes = F.transform(F.filter(F.transform(_lines(F.col(text)), _normal), lambda x: x != ""), lambda x: F.xxhash64(x))
    whole = docs.select(*[c.alias(k) for k, c in keys.items()], F.array_distinct(hashes).alias("lines"))
    return whole.select(*KEY, F.explode("lines").alias("line")).distinct()


def frequent_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, max_documents: int = MAX_DOCUMENTS, equal_texts_once: bool = True) -> DataFrame:
    """(host, line, documents): the lines that more distinct documents of a host hold than its limit: ``max_share`` of
    the host's distinct documents, but at least ``min_documents`` and at most ``max_documents``."""
    keys = _keys(docs, text, host, doc_id, equal_texts_once)
    return _above(_host_lines(docs, text, keys), docs, keys, min_documents, max_share, max_documents)


def _above(held: DataFrame, docs: DataFrame, keys: dict[str, Column], min_documents: int, max_share: float, max_documents: int) -> DataFrame:
    counts = held.groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > min_documents)
    hosts = docs.select(*[c.alias(k) for k, c in keys.items()]).distinct().groupBy("host").agg(F.count("*").alias("host_documents"))
    limit = F.least(F.col("host_documents") * max_share, F.lit(float(max_documents)))
    return counts.join(hosts, counts["host"].eqNullSafe(hosts["host"])).where(F.col("documents") > limit).select(counts["host"], "line", "documents")


def _judged(docs: DataFrame, text: str, host: str, doc_id: str, min_documents: int, max_share: float, max_documents: int, equal_texts_once: bool) -> DataFrame:
    """``docs`` in ``row``, with bad, the hashes of its lines above the limit (null where none is), and share, the share of its words in them.

    The lines above the limit and the documents that hold one are written once;
    either is broadcast only while it is small, and joined by shuffle beyond that.
    """
    scratch, keys = Scratch(docs.sparkSession), _keys(docs, text, host, doc_id, equal_texts_once)
    held = scratch.keep(_host_lines(docs, text, keys))
    bad = scratch.keep(_above(held, docs, keys, min_documents, max_share, max_documents).select(F.col("host").alias("h2"), F.col("line").alias("l2")))
    marked = held.join(broadcast_if(bad, BROADCAST_LINES), held["host"].eqNullSafe(bad["h2"]) & (held["line"] == bad["l2"]), "left_semi")
    few = scratch.keep(marked.groupBy(*[F.col(k).alias(f"r{k}") for k in KEY]).agg(F.collect_list("line").alias("bad")))
    scratch.only(few)
    joined = nested(docs, **keys).join(broadcast_if(few, BROADCAST_ROWS), [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in KEY], "left")
    own = F.col("row").getField(text)
    gone = F.filter(_lines(own), lambda x: F.array_contains("bad", F.xxhash64(_normal(x))))
    lost = F.size(words_of(F.array_join(gone, " "))) / F.size(words_of(own))
    return joined.select("row", "bad", F.when(F.col("bad").isNotNull(), lost).alias("share"))


def _failed(b: Column) -> Column:
    return (b["n_words"] < MIN_WORDS) | (b["n_repeat_words"] * 100 > b["n_words"] * MAX_REPEAT_PERCENT)


def quality_verdicts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, max_documents: int = MAX_DOCUMENTS, max_lost: float = MAX_LOST, equal_texts_once: bool = True) -> DataFrame:
    """Per row of ``docs``: its id, the base statistics, lost_share, base_failed and kept."""
    judged = _judged(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(host).alias("host")), "text", "host", "id", min_documents, max_share, max_documents, equal_texts_once)
    lost, b = F.coalesce("share", F.lit(0.0)), F.col("base")
    rows = _measured(judged.select(F.col("row.id").alias("doc_id"), "row", "share"), F.col("row.text"), "doc_id", "share")
    return rows.select("doc_id", "base.*", lost.alias("lost_share"), _failed(b).alias("base_failed"), (~_failed(b) & (lost <= max_lost)).alias("kept"))


def clean_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, max_documents: int = MAX_DOCUMENTS, max_lost: float = MAX_LOST, equal_texts_once: bool = True) -> DataFrame:
    """The documents that pass, with lines above the limit removed from their text; all other columns unchanged."""
    own = F.col("row").getField(text)
    rows = _measured(_judged(docs, text, host, doc_id, min_documents, max_share, max_documents, equal_texts_once), own, "row", "share", "bad")
    left = F.array_join(F.filter(_lines(own), lambda x: ~F.array_contains(F.col("bad"), F.xxhash64(_normal(x)))), "\n")
    passed = rows.where(~_failed(F.col("base")) & (F.coalesce("share", F.lit(0.0)) <= max_lost))
    return passed.select(*unnested(docs, **{text: F.when(F.col("bad").isNull(), own).otherwise(left).alias(text)}))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return quality_verdicts(docs)


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
doubles AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM doubles, unnest([0, 1, 2]) AS u(o) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, t, line, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS normal
  FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
repeats AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
bad AS (
  SELECT l.source, l.normal FROM lines l JOIN hosts h ON l.source = h.source
  GROUP BY l.source, l.normal, h.n HAVING count(DISTINCT l.t) > {MIN_DOCUMENTS} AND count(DISTINCT l.t) > least(h.n * {MAX_SHARE}, {MAX_DOCUMENTS})),
lost AS (SELECT l.doc_id, sum(len(list_filter(string_split(l.normal, ' '), lambda x: x <> ''))) AS n FROM lines l JOIN bad b ON l.source = b.source AND l.normal = b.normal GROUP BY l.doc_id),
counts AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(r.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, CASE WHEN l.n > 0 THEN CAST(l.n AS DOUBLE) / len(w) ELSE 0.0 END AS lost_share
  FROM d LEFT JOIN repeats r ON d.doc_id = r.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN lost l ON d.doc_id = l.doc_id)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND lost_share <= {MAX_LOST} AS kept
FROM counts
"""
