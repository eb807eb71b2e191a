"""Line dedup with a log-template tree.

Every line goes down a tree of fixed depth: its token count, then its leading
tokens, with tokens that hold a digit generalised. In a leaf that enough
documents reach, a token is fixed if enough of them have it at its position,
and a variable field otherwise; the line's template is its fixed tokens with
fields between. Templates that are mostly fixed and recur in enough distinct
documents are dropped from all documents but the one with the smallest id.
A long line (a passage) is also a template as it stands, with no field but its
tokens with digits, and recurs in fewer documents.

The tree is a sequence of aggregations keyed by hashes of leaf, position and
template: nothing is gathered per leaf or template, a common line is
pre-aggregated before each shuffle, and only lines in recurring leaves get as
far as having their tokens exploded. Lines are parsed once. Where rows of a
common line or template meet its own row, that row comes from a written table,
so that it is broadcast or the join can be split.

Defined results
- null text: stays null, no lines; null ids sort before others.
- documents of equal text count, and keep their lines, as one: whole copies are
  another operator's work. With ``equal_texts_once`` false every (id, text) counts.
- lines of fewer than ``min_tokens`` tokens are never templates, so blank lines stay.
- repeated rows come back as often; an empty table gives no rows.
- other columns are kept, whatever their names; ``n_lines`` and ``n_dropped`` are added, and replaced if present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, Scratch, broadcast_if, content_key, let, nested, once, unnested

MIN_TOKENS = 3
#: Leading tokens in a path of the tree; with the token count its depth is one more.
LEADING = 3
MIN_DOCUMENTS = 5
#: Least share of a template's tokens that is fixed.
MIN_FIXED = 0.7
#: Tokens from which a line is a template as it stands, and documents in which it recurs then.
LONG_TOKENS, LONG_DOCUMENTS = 50, 2
#: Documents with lines to drop that may be broadcast, and leaves, lines or templates.
BROADCAST_ROWS, BROADCAST_KEYS = 200_000, 1_000_000
FIELD = "<*>"
KEY = ["content_a", "content_b"]


def _normal(line: Column) -> Column:
    """Lower case, tokens with a digit generalised, one space between tokens. Either replacement runs only on lines that need it."""
    low = F.lower(line)

    def masked(x: Column) -> Column:
        return F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", FIELD)).otherwise(x)

    def spaced(x: Column) -> Column:
        return F.trim(F.when(x.rlike(r"[\x09-\x0D]|  "), F.regexp_replace(x, BLANK, " ")).otherwise(x))

    return let(low, lambda x: let(masked(x), spaced))


def _line_key(line: Column) -> Column:
    return F.xxhash64(_normal(line))


def _keys(text: Column, doc_id: Column, equal_texts_once: bool) -> dict[str, Column]:
    return dict(zip(KEY, content_key(text) if equal_texts_once else content_key(text, doc_id), strict=True))


def _parsed(docs: DataFrame, doc_id: str, text: str, min_tokens: int, leading: int, equal_texts_once: bool) -> DataFrame:
    """(id, content, n, leaf, line, normal), one row for each line long enough."""
    keys = _keys(F.col(text), F.col(doc_id), equal_texts_once)
    whole = docs.select(F.col(doc_id).alias("id"), *[c.alias(k) for k, c in keys.items()], F.split(F.col(text), "\n").alias("lines"))
    rows = whole.select("id", *KEY, F.explode("lines").alias("raw"))  # the keys are made before, once a document
    rows = rows.select("id", *KEY, once(_normal(F.col("raw"))).alias("normal"))
    count = F.length("normal") - F.length(F.replace("normal", F.lit(" "), F.lit(""))) + 1
    rows = rows.withColumn("n", count).where(F.col("n") >= min_tokens)
    return rows.select("id", *KEY, "n", F.xxhash64("n", F.substring_index("normal", " ", leading)).alias("leaf"), F.xxhash64("normal").alias("line"), "normal")


def _documents(rows: DataFrame, *key: str) -> DataFrame:
    """Distinct documents for each key, deduplicated on both sides of the shuffle."""
    return rows.select(*key, *KEY).distinct().groupBy(*key).agg(F.count("*").alias("documents"))


def recurring_templates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_documents: int = MIN_DOCUMENTS, min_tokens: int = MIN_TOKENS, leading: int = LEADING, min_fixed: float = MIN_FIXED, long_tokens: int = LONG_TOKENS, long_documents: int = LONG_DOCUMENTS, equal_texts_once: bool = True, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(templates, lines): leaf, template, whole (a long line as it stands), words, documents and first document of each
    recurring template; and the lines that have a template, by document. Both are written tables."""
    scratch, template = scratch or Scratch(docs.sparkSession), ["leaf", "template", "whole"]
    rows = scratch.keep(_parsed(docs, doc_id, text, min_tokens, leading, equal_texts_once))
    least = F.when(F.col("n") >= long_tokens, min(long_documents, min_documents)).otherwise(min_documents)
    leaves = _documents(rows, "leaf", "n").where(F.col("documents") >= least)
    leaves = scratch.keep(leaves.select("leaf", (F.col("documents") >= min_documents).alias("wide")))
    # A line travels once for each document that holds it, in recurring leaves only.
    held = rows.join(broadcast_if(leaves, BROADCAST_KEYS), "leaf").groupBy("leaf", "line", *KEY).agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("wide").alias("wide"), F.first("normal").alias("normal"))
    held = scratch.keep(held)
    scratch.free(rows)
    lines = held.groupBy("leaf", "line").agg(F.count("*").alias("documents"), F.first("n").alias("n"), F.first("wide").alias("wide"), F.first("normal").alias("normal"))
    lines = scratch.keep(lines)
    spread = lines.where("wide").select("leaf", "line", "documents", F.posexplode(F.split("normal", " ")).alias("pos", "token"))
    common = spread.groupBy("leaf", "pos", "token").agg(F.sum("documents").alias("n")).where(F.col("n") >= min_documents).drop("n")
    fixed = spread.join(common.withColumn("fixed", F.lit(True)), ["leaf", "pos", "token"], "left")
    shown = F.when(F.col("fixed"), F.col("token")).otherwise(FIELD)
    made = fixed.groupBy("leaf", "line").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", shown.alias("t")))), lambda x: x["t"]).alias("words"),
        F.count(F.when(F.col("fixed") & (F.col("token") != FIELD), 1)).alias("n_fixed"),
    )
    made = made.where(F.col("n_fixed") >= F.size("words") * min_fixed).select("leaf", "line", F.array_join("words", " ").alias("words"), F.lit(False).alias("whole"))
    solid = F.size(F.filter(F.split("normal", " "), lambda x: x != FIELD)) >= F.col("n") * min_fixed
    passages = lines.where((F.col("n") >= long_tokens) & (F.col("documents") >= long_documents) & solid).select("leaf", "line", F.col("normal").alias("words"), F.lit(True).alias("whole"))
    made = scratch.keep(made.unionByName(passages).withColumn("template", F.xxhash64("words")))
    matched = held.select("leaf", "line", "id", *KEY).join(broadcast_if(made.drop("words"), BROADCAST_KEYS), ["leaf", "line"])
    matched = scratch.keep(matched)
    scratch.free(held, lines)
    # The first of a template's documents is the content that keeps its lines.
    first = matched.groupBy(*template).agg(F.min(F.struct("id", *KEY)).alias("first"))
    enough = _documents(matched, *template).where(F.col("documents") >= F.when(F.col("whole"), long_documents).otherwise(min_documents))
    said = made.groupBy(*template).agg(F.first("words").alias("words"))
    return scratch.keep(first.join(enough, template).join(said, template)), matched


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_documents: int = MIN_DOCUMENTS, min_tokens: int = MIN_TOKENS, leading: int = LEADING, min_fixed: float = MIN_FIXED, long_tokens: int = LONG_TOKENS, long_documents: int = LONG_DOCUMENTS, equal_texts_once: bool = True, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with recurring lines dropped from the text, and columns of these names with its lines and those dropped."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop(n_lines, n_dropped)
    templates, lines = recurring_templates(docs, doc_id=doc_id, text=text, min_documents=min_documents, min_tokens=min_tokens, leading=leading, min_fixed=min_fixed, long_tokens=long_tokens, long_documents=long_documents, equal_texts_once=equal_texts_once, scratch=scratch)
    first = templates.select("leaf", "template", "whole", *[F.col(f"first.{k}").alias(f"first_{k}") for k in KEY])
    others = lines.join(broadcast_if(first, BROADCAST_KEYS), ["leaf", "template", "whole"]).where("content_a <> first_content_a or content_b <> first_content_b")
    drops = scratch.keep(others.groupBy(*KEY).agg(F.collect_set("line").alias("drop")))
    scratch.only(drops)
    own = F.col("row").getField(text)
    joined = nested(docs, **_keys(F.col(text), F.col(doc_id), equal_texts_once)).join(broadcast_if(drops, BROADCAST_ROWS), KEY, "left")
    all_lines = F.split(own, "\n")
    left = F.filter(all_lines, lambda x: ~F.array_contains("drop", _line_key(x)))
    step = joined.withColumn("left", F.when(F.col("drop").isNotNull(), left))
    n = F.coalesce(F.size(all_lines), F.lit(0))
    kept = unnested(docs, **{text: F.when(F.col("drop").isNull(), own).otherwise(F.array_join("left", "\n")).alias(text)})
    return step.select(*kept, F.when(own.isNull(), 0).otherwise(n).alias(n_lines), F.when(F.col("drop").isNull(), 0).otherwise(n - F.size("left")).alias(n_dropped))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"))


SQL = rf"""
WITH split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
parsed AS (
  SELECT *, list_transform(list_filter(string_split_regex(lower(raw), '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END) AS tokens FROM split),
leafed AS (SELECT *, array_to_string(tokens, ' ') AS line, len(tokens) || ' ' || array_to_string(tokens[1:{LEADING}], ' ') AS leaf FROM parsed WHERE len(tokens) >= {MIN_TOKENS}),
leaves AS (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT text) >= CASE WHEN any_value(len(tokens)) >= {LONG_TOKENS} THEN {LONG_DOCUMENTS} ELSE {MIN_DOCUMENTS} END),
held AS (SELECT leaf, line, text, min(doc_id) AS id, any_value(tokens) AS tokens FROM leafed WHERE leaf IN (SELECT leaf FROM leaves) GROUP BY leaf, line, text),
lines AS (SELECT leaf, line, count(*) AS documents, any_value(tokens) AS tokens FROM held GROUP BY leaf, line),
spread AS (SELECT leaf, line, documents, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM lines),
common AS (SELECT leaf, pos, token FROM spread GROUP BY leaf, pos, token HAVING sum(documents) >= {MIN_DOCUMENTS}),
made AS (
  SELECT s.leaf, s.line, string_agg(CASE WHEN c.token IS NULL THEN '{FIELD}' ELSE s.token END, ' ' ORDER BY s.pos) AS template
  FROM spread s LEFT JOIN common c ON s.leaf = c.leaf AND s.pos = c.pos AND s.token = c.token
  GROUP BY s.leaf, s.line HAVING count(CASE WHEN c.token <> '{FIELD}' THEN 1 END) >= count(*) * {MIN_FIXED}),
matched AS (SELECT h.leaf, h.line, h.text, h.id, m.template FROM held h JOIN made m ON h.leaf = m.leaf AND h.line = m.line),
recurring AS (SELECT leaf, template, arg_min(text, id) AS first_text FROM matched GROUP BY leaf, template HAVING count(DISTINCT text) >= {MIN_DOCUMENTS}),
passages AS (SELECT leaf, line, arg_min(text, id) AS first_text FROM held WHERE len(tokens) >= {LONG_TOKENS} AND len(list_filter(tokens, lambda x: x <> '{FIELD}')) >= len(tokens) * {MIN_FIXED} GROUP BY leaf, line HAVING count(*) >= {LONG_DOCUMENTS}),
drops AS (
  SELECT m.text, m.line FROM matched m JOIN recurring r ON m.leaf = r.leaf AND m.template = r.template AND m.text <> r.first_text
  UNION SELECT h.text, h.line FROM held h JOIN passages p ON h.leaf = p.leaf AND h.line = p.line AND h.text <> p.first_text),
marked AS (SELECT p.doc_id, p.line_no, p.raw, d.line IS NOT NULL AS gone FROM parsed p LEFT JOIN drops d ON p.text = d.text AND array_to_string(p.tokens, ' ') = d.line)
SELECT doc_id, coalesce(string_agg(CASE WHEN NOT gone THEN raw END, chr(10) ORDER BY line_no), '') AS text, count(*) AS n_lines, CAST(count(CASE WHEN gone THEN 1 END) AS BIGINT) AS n_dropped
FROM marked GROUP BY doc_id
"""
