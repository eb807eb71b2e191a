"""Mixing sources to target weights by Poisson replication.

Each source gets a target share of the output and so a mean repetition rate
(target characters over its characters). A document's count is the inverse of
the Poisson distribution with that mean at a uniform number hashed from seed
and id; the document is exploded by its count and all rows are shuffled by a
hashed key. Rates above ``PIECE`` are cut into equal independent pieces whose
counts add up, which is again exactly Poisson and keeps tables short.

Defined results: null text has length 0; null source is a source; a null id
hashes like the text 'null'; rows that repeat an id repeat its count; a source
without characters is mixed by rows of length 1 each; an empty table gives no rows.
All columns are kept, whatever their names; ``copy`` (from 0) is added, and replaced if present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if, nested, unnested

SEED = 11
#: Target weight of a source: its size to this power (natural sizes at 1, all alike at 0).
ALPHA = 0.5
#: Size of the output over that of the input.
EPOCHS = 1.0
#: Largest mean of one piece, and counts listed for it: beyond them lies less than 1e-17 of the distribution.
PIECE, LISTED = 16.0, 80
#: Sources whose rates may be broadcast, at up to 700 bytes each.
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: DataFrame | dict[str, float] | None = None, *, text: str = "text", source: str = "source", alpha: float = ALPHA, epochs: float = EPOCHS) -> DataFrame:
    """(_source, size, rate). ``weights``: (source, weight) of any scale; sources it does not list get none."""
    size = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)).cast("long")
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        if isinstance(weights, dict):
            weights = docs.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        weighed = sizes.join(w, F.col("_source").eqNullSafe(F.col("w_source"))).drop("w_source")
    whole = weighed.agg(F.sum("weight").alias("all_weight")).crossJoin(sizes.agg(F.sum("size").alias("all_size")))  # one row
    share = F.col("weight") / F.col("all_weight")
    return weighed.crossJoin(F.broadcast(whole)).select("_source", "size", F.round(share * F.col("all_size") * epochs / F.col("size"), 12).alias("rate"))


def _listed(rate: Column) -> Column:
    """The distribution function of one piece at 0, 1, ..., rounded so that other engines agree on it."""
    step = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.round(F.exp(-rate), 13)).alias("a"))

    def more(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["a"], F.array(F.round(s["c"] + p, 13))).alias("a"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LISTED)), step, more)["a"]


def mix(docs: DataFrame, weights: DataFrame | dict[str, float] | None = None, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", alpha: float = ALPHA, epochs: float = EPOCHS, seed: int = SEED, copy: str = "copy") -> DataFrame:
    """The replicated documents in shuffled order, with their copy's number in a column ``copy`` (of that or another name)."""
    spark = docs.sparkSession
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    made = rates(docs, weights, text=text, source=source, alpha=alpha, epochs=epochs).withColumn("pieces", pieces)
    made = Scratch(spark).keep(made.select("_source", "pieces", _listed(F.col("rate") / F.col("pieces")).alias("cdf")))
    docs = docs.drop(copy)
    rows = nested(docs, source=F.col(source), key=F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    joined = rows.join(broadcast_if(made, BROADCAST_SOURCES), rows["source"].eqNullSafe(made["_source"]))
    drawn = F.transform(F.sequence(F.lit(1), F.col("pieces")), lambda j: uniform(F.lit(str(seed)), F.col("key"), j.cast("string")))
    counts = F.transform(drawn, lambda u: F.size(F.filter("cdf", lambda c: c <= u)))
    times = F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    spread = joined.select("row", "key", times.alias("times")).where("times > 0")
    spread = spread.select("row", "key", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "key", F.col("copy").cast("string"), F.lit("order")))
    shuffled = spread.select("row", "copy", order.alias("order")).repartition("order").sortWithinPartitions("order")
    return shuffled.select(*unnested(docs), F.col("copy").alias(copy))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "source", "copy", "text")


SQL = f"""
WITH sizes AS (SELECT source, CAST(sum(greatest(coalesce(length(text), 0), 1)) AS BIGINT) AS size FROM documents GROUP BY source),
whole AS (SELECT sum(pow(CAST(size AS DOUBLE), {ALPHA})) AS w, CAST(sum(size) AS BIGINT) AS s FROM sizes),
rates AS (SELECT source, round(pow(CAST(size AS DOUBLE), {ALPHA}) / w * s * {EPOCHS} / size, 12) AS rate FROM sizes, whole),
pieces AS (SELECT source, rate, greatest(CAST(ceil(rate / {PIECE}) AS INT), 1) AS pieces FROM rates),
pmf AS (SELECT source, k, CASE WHEN k = 0 THEN exp(-rate / pieces) ELSE exp(-rate / pieces + k * ln(rate / pieces) - lgamma(k + 1)) END AS p
        FROM pieces, (SELECT unnest(range(0, {LISTED + 1})) AS k)),
cdf AS (SELECT source, k, round(sum(p) OVER (PARTITION BY source ORDER BY k), 13) AS c FROM pmf),
drawn AS (SELECT d.doc_id, d.source, d.text, j, CAST('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || j), 1, 13) AS BIGINT) / CAST({2**52} AS DOUBLE) AS u
          FROM documents d JOIN pieces p ON d.source = p.source, unnest(range(1, p.pieces + 1)) AS t(j)),
counted AS (SELECT doc_id, drawn.source, text, count(cdf.k) AS times FROM drawn LEFT JOIN cdf ON drawn.source = cdf.source AND cdf.c <= drawn.u GROUP BY doc_id, drawn.source, text)
SELECT doc_id, source, CAST(copy AS INT) AS copy, text FROM counted, unnest(range(0, times)) AS t(copy)
"""
