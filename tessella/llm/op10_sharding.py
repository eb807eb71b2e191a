"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents of equal text form a group. Every group is placed as a vector (bytes,
tokens, rows), largest first, in the shard whose residual capacity has the
highest dot product with it. The same rule runs on two levels:

- groups of at least 1/``LARGE`` of all bytes, tokens or rows, of which there are
  at most ``LARGE`` by each, are placed first, on the driver. One that is over an
  eighth of a shard by any measure could not be balanced whole and is split by row
  into parts of about that size;
- what capacity they leave is dealt to buckets of groups by the hash of their
  text, in proportion to what each bucket holds, and each bucket places its
  groups one by one against its own share. A bucket holds a bounded number of rows
  on average, and no group in it is large.

Law: ``bytes``. After placement, exchanges of single groups between the shards
furthest over and under their share bring the bytes of a bucket together.

Texts are read once and never shuffled; a slim row for each document is. Slots
are ranks within bucket and shard plus the count of lower buckets, so no task
ranks a shard or a hot group.

Defined results: null text counts as empty; a null id is an id of its own;
repeated rows are rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import Scratch, broadcast_if, content_key, nested, unnested, words_of

SHARDS = 8
LARGE = 4096
#: Rows of a bucket: the fewer while there are up to ``FEW_BUCKETS`` buckets, the more beyond.
BUCKET_ROWS, FEW_BUCKETS, MOST_ROWS = 2_000, 256, 50_000
#: Buckets and shards whose offsets may be broadcast.
BROADCAST_ROWS = 1_000_000
KEY = ["content_a", "content_b"]
MEASURES = ["bytes", "tokens", "rows"]
#: Weights of the measures: bytes weigh most, because they are the law.
WEIGHT = np.array([8.0, 1.0, 1.0])


def place(vectors: np.ndarray, capacity: np.ndarray, first: int = 0) -> np.ndarray:
    """The shard of each vector: largest in bytes first, where its dot product with the residual capacity is highest.
    ``first`` is the shard that wins ties."""
    shards = len(capacity)
    order = (np.arange(shards) + first) % shards
    scale = np.maximum(capacity.sum(axis=0), 1.0)
    share, residual = vectors / scale, capacity[order] / scale
    out = np.zeros(len(vectors), dtype=np.int32)
    for i in np.lexsort((np.arange(len(vectors)), -share[:, 0])):
        k = int(np.argmax(residual @ (share[i] * WEIGHT)))
        residual[k] -= share[i]
        out[i] = order[k]
    return out


def even_out(size: np.ndarray, where: np.ndarray, target: np.ndarray, tolerance: float = 1e-4, rounds: int = 1000) -> np.ndarray:
    """Exchange one item of the shard furthest over its target for a lighter one of the shard furthest under, while that
    brings them together; counts of items stay."""
    where = where.copy()
    over = np.bincount(where, weights=size, minlength=len(target)) - target
    for _ in range(rounds):
        hi, lo = int(over.argmax()), int(over.argmin())
        gap = over[hi] - over[lo]
        if gap <= tolerance * target.mean():
            break
        a, b = np.flatnonzero(where == hi), np.flatnonzero(where == lo)
        if not len(a) or not len(b):
            break
        b = b[np.argsort(size[b], kind="stable")]
        at = np.searchsorted(size[b], size[a] - gap / 2)
        best = None
        for k in (np.minimum(at, len(b) - 1), np.maximum(at - 1, 0)):
            moved = size[a] - size[b[k]]
            miss = np.where((moved > 0) & (moved < gap), np.abs(moved - gap / 2), np.inf)
            i = int(miss.argmin())
            if np.isfinite(miss[i]) and (best is None or miss[i] < best[0]):
                best = miss[i], a[i], b[k[i]], moved[i]
        if best is None:
            break
        where[best[1]], where[best[2]] = lo, hi
        over[hi] -= best[3]
        over[lo] += best[3]
    return where


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One slim row for each document; ``row`` tells apart rows that are equal otherwise."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), *content_key(t), (F.octet_length(t) + 1).cast("long").alias("size"), F.size(words_of(t)).cast("long").alias("tokens"), F.crc32(t).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))


def _sums() -> list:
    return [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]


def _settled(rows: DataFrame, residual: np.ndarray, exchange: bool) -> DataFrame:
    """(doc_id, size, text_crc32, bucket, shard, at): buckets placed, and each row's rank in its bucket and shard."""
    shares = residual / np.maximum(residual.sum(axis=0), 1e-9)
    names = ["doc_id", "size", "text_crc32", "bucket"]

    def settle(table: pa.Table) -> pa.RecordBatch:
        a, b, size, tokens, fixed, bucket = (table.column(c).to_numpy() for c in (*KEY, "size", "tokens", "fixed", "bucket"))
        shard, light = fixed.copy(), np.flatnonzero(fixed < 0)
        if len(light):
            begins = np.concatenate([[True], (np.diff(a[light]) != 0) | (np.diff(b[light]) != 0)])  # rows of a group follow one another
            starts = np.flatnonzero(begins)
            vectors = np.stack([np.add.reduceat(x, starts) for x in (size[light], tokens[light], np.ones(len(light), np.int64))], axis=1).astype(float)
            capacity = vectors.sum(axis=0) * shares
            where = place(vectors, capacity, int(bucket[0]))
            if exchange:
                where = even_out(vectors[:, 0], where, capacity[:, 0])
            shard[light] = where[np.cumsum(begins) - 1]
        order = np.argsort(shard, kind="stable")
        edge = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1])
        at = np.empty(len(shard), np.int64)
        at[order] = np.arange(len(shard)) - np.repeat(edge, np.diff(np.append(edge, len(shard))))
        own = table.select(names).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*own.columns, pa.array(shard.astype(np.int32)), pa.array(at)], names=[*names, "shard", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if held and held[0].column(held[0].schema.get_field_index("bucket"))[0].as_py() != int(bucket[lo]):
                    yield settle(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield settle(pa.Table.from_batches(held))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.repartition("bucket").sortWithinPartitions("bucket", *KEY, "row").mapInArrow(run, f"doc_id {kind}, size long, text_crc32 long, bucket long, shard int, at long")


def shard_assignments(docs: DataFrame, *, shards: int = SHARDS, large: int = LARGE, bucket_rows: int = BUCKET_ROWS, exchange: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, bucket, shard, slot) for every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = scratch.keep(_rows(docs, doc_id, text))
    total = {k: n or 0 for k, n in rows.agg(*_sums()).first().asDict().items()}
    # By each measure at most ``large`` groups reach its least.
    reach = reduce(or_, [F.col(k) >= max(1, -(-total[k] // large)) for k in MEASURES])
    parts = F.greatest(*[F.ceil(F.col(k) / max(1, total[k] // (8 * shards))).cast("long") for k in MEASURES])
    heavy = rows.groupBy(*KEY).agg(*_sums()).where(reach).select(*KEY, parts.alias("parts")).orderBy(*KEY).collect()
    first, listed = 0, []
    for g in heavy:
        listed.append((g["content_a"], g["content_b"], first, g["parts"]))
        first += g["parts"]
    schema = T.StructType([T.StructField("h_a", T.LongType()), T.StructField("h_b", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("parts", T.LongType())])
    found = F.broadcast(spark.createDataFrame(listed, schema))
    item = F.col("first") + F.pmod(F.xxhash64("row", F.lit(7)), F.col("parts"))
    marked = rows.join(found, (F.col("content_a") == F.col("h_a")) & (F.col("content_b") == F.col("h_b")), "left").select(*rows.columns, item.alias("item"))
    sums = marked.where("item is not null").groupBy("item").agg(*_sums()).orderBy("item").collect()
    vectors = np.array([[s[k] for k in MEASURES] for s in sums], dtype=float).reshape(-1, 3)
    capacity = np.tile(np.array([total[k] for k in MEASURES], dtype=float) / shards, (shards, 1))
    where = place(vectors, capacity)
    if exchange and len(vectors):
        where = even_out(vectors[:, 0], where, np.full(shards, vectors[:, 0].sum() / shards))
    residual = capacity.copy()
    np.subtract.at(residual, where, vectors)
    residual = np.maximum(residual, 0.0)
    fixed = F.broadcast(spark.createDataFrame([(s["item"], k) for s, k in zip(sums, where.tolist(), strict=True)], T.StructType([T.StructField("item", T.LongType()), T.StructField("fixed", T.IntegerType())])))
    buckets = max(1, min(total["rows"] // bucket_rows, FEW_BUCKETS), total["rows"] // MOST_ROWS)
    bucket = F.pmod(F.when(F.col("fixed").isNull(), F.xxhash64(*KEY)).otherwise(F.xxhash64("row", F.lit(9))), F.lit(buckets))
    dealt = marked.join(fixed, "item", "left").select(*rows.columns, F.coalesce("fixed", F.lit(-1)).alias("fixed"), bucket.cast("long").alias("bucket"))
    placed = scratch.keep(_settled(dealt, residual, exchange))
    below = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    offsets = scratch.keep(counts.select("bucket", "shard", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("offset")))  # a row for each bucket and shard
    scratch.only(placed, offsets)
    return placed.join(broadcast_if(offsets, BROADCAST_ROWS), ["bucket", "shard"]).select("doc_id", "size", "text_crc32", "bucket", "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, *, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the documents as Parquet under ``path``/shard=k/, in slot order within each file range; columns ``shard``
    and ``slot`` are replaced. Ids must be unique here."""
    where = shard_assignments(docs, shards=shards, doc_id=doc_id, text=text).select(F.col("doc_id").alias("at"), "shard", "slot")
    docs = docs.drop("shard", "slot")
    rows = nested(docs, id=F.col(doc_id)).join(where, F.col("id").eqNullSafe(F.col("at"))).select(*unnested(docs), "shard", "slot")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = shard_assignments(docs)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
