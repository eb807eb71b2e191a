"""Embedding near-duplicates by product quantisation.

Unit vectors go to coarse inverted lists; what remains of a vector after its
list's centroid is coded in subspaces. A vector probes the lists nearest to it,
sums table look-ups for the codes of a list's members (asymmetric distance),
keeps those whose true distance can still be small enough (the length of each
member's coding error is stored, so this step loses nothing), and ranks the rest
by exact cosine in double precision. Lists are numbered, and of two lists only
the lower probes the higher, so a pair is seen once. Of the nearest lists a vector
skips those that cannot hold a link: what is near enough to it and belongs to
another list lies close to the plane between both centroids.

Equal vectors are one class with a size; links are counted by weight, and every
block emits counts and the edges of a spanning forest, never pairs. A list of
many members is split into blocks of bounded size.

The index holds each vector once, with its list, codes and probes; copies of it
are made on the way to the lists it probes. The quantisers are fitted on a sample
of ``SAMPLE_PER_LIST`` vectors a list, those of least hashed id, and at most
``SAMPLE_BYTES``. Every vector is indexed.

Defined results
- vectors of different lengths do not compare; each length has an index of its own.
- null, zero, with null or non-finite components, or the only one of its length:
  linked with nothing, a component of its own.
- rows that repeat an id or a vector are vectors of their own; a null id never
  names a component where another id is there, and is not kept.
- empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .batches import BATCH
from .common import Scratch, broadcast_if
from .components import components

COSINE = 0.95
#: Lists are about this many times the root of the number of vectors, within the bounds.
LISTS_PER_ROOT, LEAST_LISTS, MOST_LISTS = 4.0, 16, 65_536
SAMPLE_PER_LIST = 32
#: Most bytes of the sample and of the centroids, as 32-bit numbers on the driver.
SAMPLE_BYTES, CENTRE_BYTES = 128 << 20, 32 << 20
#: Clusters that are fitted at once; more are fitted within clusters.
_FLAT = 1024
#: Lists that may be broadcast with their numbers of blocks.
BROADCAST_LISTS = 100_000
PROBES = 32
SUBSPACES, CODES = 8, 64
BLOCK = 1024
_QUERIES = 256


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the square of x."""
    return (centres * centres).sum(axis=1)[None, :] - 2.0 * x @ centres.T


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_nearest(part, centres).argmin(axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(count[filled])[:-1]]), axis=0)
        centres[filled] = sums / count[filled, None]
    return centres


def _centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means; beyond ``_FLAT`` centres within about root k clusters, so that fitting takes k * root k."""
    if k <= _FLAT:
        return _kmeans(x, k, 8, seed)
    top = _kmeans(x, int(k**0.5), 8, seed)
    near = np.concatenate([_nearest(p, top).argmin(axis=1) for p in np.array_split(x, max(1, len(x) // 4096))])
    return np.concatenate([_kmeans(own, max(1, round(k * len(own) / len(x))), 8, seed + 1) for i in range(len(top)) if len(own := x[near == i])])


class Quantiser:
    """Coarse centroids and, for each subspace of their residuals, a code book."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 5):
        self.centres = _centres(sample, lists, seed)
        near = np.concatenate([_nearest(p, self.centres).argmin(axis=1) for p in np.array_split(sample, max(1, len(sample) // 4096))])
        rest = sample - self.centres[near]
        self.cuts = [c for c in np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))]
        self.books = [_kmeans(np.ascontiguousarray(rest[:, c]), codes, 6, seed + 1 + i) for i, c in enumerate(self.cuts)]

    def lists(self, x: np.ndarray, probes: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The nearest lists of each vector, nearest first, and which of them may hold a vector within ``reach`` of it."""
        d = _nearest(x, self.centres)
        p = min(probes, d.shape[1])
        top = np.argpartition(d, p - 1, axis=1)[:, :p]
        top = np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, axis=1), axis=1, kind="stable"), axis=1)
        beyond = np.take_along_axis(d, top, axis=1)
        apart = np.sqrt(np.maximum(((self.centres[top] - self.centres[top[:, :1]]) ** 2).sum(axis=2), 0))
        return top, beyond - beyond[:, :1] <= 2 * reach * apart + 1e-4

    def encode(self, x: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they miss."""
        rest = x - self.centres[where]
        codes = np.stack([_nearest(rest[:, c], b).argmin(axis=1) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        told = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((rest - told) ** 2).sum(axis=1))

    def distances(self, x: np.ndarray, where: int, codes: np.ndarray) -> np.ndarray:
        """Distances from each x to the coded members of a list, by table look-up."""
        rest = x - self.centres[where]
        out = np.zeros((len(x), len(codes)), dtype=np.float32)
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            own = rest[:, c]
            table = (own * own).sum(axis=1)[:, None] + _nearest(own, b)
            out += table.astype(np.float32)[:, codes[:, i]]
        return np.sqrt(np.maximum(out, 0))


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _valid(vector: str, dims: int | None = None):
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(sound & (F.size(v) == dims) if dims else sound, F.lit(False))


def _index(classes: DataFrame, quantiser, dims: int, probes: int, cosine: float) -> DataFrame:
    """(cid, size, vector, list, codes, error, probes): probes are the higher lists in which a link may be."""
    reach = _reach(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = quantiser.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = _unit(_matrix(part.column(2), dims)).astype(np.float32)
                near, may = q.lists(x, probes, reach)
                own = near[:, 0]
                codes, error = q.encode(x, own)
                may &= near > own[:, None]  # a pair's lower list probes the higher
                ends = np.concatenate([[0], np.cumsum(may.sum(axis=1))]).astype(np.int32)
                probed = pa.ListArray.from_arrays(pa.array(ends), pa.array(near[may].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float32)), probed], names=["cid", "size", "vector", "list", "codes", "error", "probes"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("cid", "size", "vector").mapInArrow(run, f"cid long, size long, vector {kind}, list int, codes binary, error float, probes array<int>")


def _reach(cosine: float) -> float:
    """Distance of unit vectors within which they may link."""
    return float(np.sqrt(2.0 - 2.0 * cosine)) + 1e-4


def _search(rows: DataFrame, quantiser, dims: int, cosine: float) -> DataFrame:
    """(cid, links, other): counts of links by weight (other null), and edges of a spanning forest (links 0)."""
    reach = _reach(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = quantiser.value
        block = None
        cids = sizes = x = codes = error = counts = root = None
        parts: list[tuple] = []

        def told(a: np.ndarray, links: np.ndarray, other: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], names=["cid", "links", "other"])

        def join(near: np.ndarray) -> None:
            """Put what these members are joined to under one root; ``root`` is kept flat."""
            r = np.unique(root[near])
            if len(r) > 1:
                root[np.isin(root, r)] = r[0]

        def compare(y: np.ndarray, weights: np.ndarray, list_: int) -> np.ndarray:
            maybe = q.distances(y.astype(np.float32), list_, codes) <= reach + error[None, :]
            r, c = np.nonzero(maybe)
            exact = np.einsum("ij,ij->i", y[r], x[c]) >= cosine
            out = np.zeros(maybe.shape, dtype=bool)
            out[r[exact], c[exact]] = True
            return out

        def flush() -> Iterator[pa.RecordBatch]:
            if block is None or cids is None:
                return
            out = np.flatnonzero(counts)
            yield told(cids[out], counts[out], [None] * len(out))
            tied = np.flatnonzero(root != np.arange(len(root)))
            yield told(cids[tied], np.zeros(len(tied), np.int64), cids[root[tied]].tolist())

        def begin() -> None:
            """The block's members are complete."""
            nonlocal cids, sizes, x, codes, error, counts, root
            cids, sizes, x = (np.concatenate([p[i] for p in parts]) for i in range(3))
            codes, error = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
            counts, root = np.zeros(len(cids), np.int64), np.arange(len(cids))

        def look(at: tuple[int, int], kind: int, q_ids: np.ndarray, q_sizes: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            linked = compare(y, q_sizes, at[0])
            linked &= q_ids[:, None] != cids[None, :]
            if kind == 2:  # within a list both ends probe each other
                counts[:] += (linked * q_sizes[:, None]).sum(axis=0)
            some = np.flatnonzero(linked.any(axis=1))
            if len(some):
                yield told(q_ids[some], (linked[some] * sizes[None, :]).sum(axis=1), [None] * len(some))
                first = linked[some].argmax(axis=1)
                yield told(q_ids[some], np.zeros(len(some), np.int64), cids[first].tolist())
                for i in some:
                    join(np.flatnonzero(linked[i]))

        for batch in batches:
            lists, blocks, kinds = (batch.column(i).to_numpy() for i in range(3))
            edge = np.flatnonzero((np.diff(lists) != 0) | (np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                at = (int(lists[lo]), int(blocks[lo]))
                if at != block:
                    yield from flush()
                    block, cids, parts = at, None, []
                for s in range(lo, hi, _QUERIES):
                    part = batch.slice(s, min(_QUERIES, hi - s))
                    ids, weights = part.column(3).to_numpy(), part.column(4).to_numpy()
                    y = _unit(_matrix(part.column(5), dims))
                    if kinds[lo] == 0:
                        parts.append((ids, weights, y, np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint8).reshape(len(ids), -1), part.column(7).to_numpy()))
                    elif cids is not None or parts:
                        if cids is None:
                            begin()
                        yield from look(at, int(kinds[lo]), ids, weights, y)
        yield from flush()

    keyed = rows.select("list", "block", "kind", "cid", "size", "vector", "codes", "error")
    return keyed.repartition("list", "block").sortWithinPartitions("list", "block", "kind").mapInArrow(run, "cid long, links long, other long")


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, probes: int = PROBES, lists: int | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector"))
    sizes = rows.where(_valid("vector")).groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "d")
    lengths = [r["d"] for r in sizes.collect()]  # one short row for each length that occurs twice
    compared = F.coalesce(_valid("vector") & F.size("vector").isin(lengths), F.lit(False)) if lengths else F.lit(False)
    own = F.col("vec_id")
    out = rows.where(~compared).select("vec_id", F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), own.isNotNull().alias("kept"))
    for d in lengths:
        out = out.unionByName(_of_length(rows.where(_valid("vector", d)), d, cosine, probes, lists, block))
    return out


def _of_length(sound: DataFrame, dims: int, cosine: float, probes: int, lists: int | None, block: int) -> DataFrame:
    """The result for sound vectors of one length."""
    spark = sound.sparkSession
    scratch = Scratch(spark)
    classes = sound.groupBy("vector").agg(F.count("*").alias("size"), F.min("vec_id").alias("rep")).withColumn("cid", F.monotonically_increasing_id())
    classes = scratch.keep(classes)
    n = classes.count()
    lists = lists or int(min(MOST_LISTS, max(LEAST_LISTS, LISTS_PER_ROOT * n**0.5), max(LEAST_LISTS, CENTRE_BYTES // (4 * dims))))
    sample = classes.select("vector").orderBy(F.xxhash64("rep", "vector")).limit(max(lists, min(SAMPLE_PER_LIST * lists, SAMPLE_BYTES // (4 * dims)))).toArrow()
    fitted = spark.sparkContext.broadcast(Quantiser(_unit(_matrix(sample.column(0).combine_chunks(), dims)).astype(np.float32), lists))  # lists * dims numbers
    index = scratch.keep(_index(classes, fitted, dims, probes, cosine), BATCH)
    counts = broadcast_if(scratch.keep(index.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))), BROADCAST_LISTS)
    members = index.join(counts, "list").withColumn("kind", F.lit(0)).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # Probes (kind 2), and members as probes of their own list (kind 1), meet every block of the list.
    to = F.concat(F.array(F.struct(F.col("list"), F.lit(1).alias("kind"))), F.transform("probes", lambda p: F.struct(p.alias("list"), F.lit(2).alias("kind"))))
    probing = index.select("cid", "size", "vector", F.explode(to).alias("to")).select("cid", "size", "vector", "to.list", "to.kind").join(counts, "list")
    probing = probing.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("codes", F.lit(None).cast("binary")).withColumn("error", F.lit(0.0).cast("float"))
    names = ["list", "block", "kind", "cid", "size", "vector", "codes", "error"]
    found = scratch.keep(_search(members.select(*names).unionByName(probing.select(*names)), fitted, dims, cosine), BATCH)
    scratch.free(index)
    edges = found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    labels = components(edges, scratch)
    links = found.where("other is null").groupBy("cid").agg(F.sum("links").alias("links"))
    told = classes.join(labels, classes["cid"] == labels["node"], "left").join(links, "cid", "left").select("cid", "vector", "size", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "cid").alias("label"))
    told = scratch.keep(told)
    names = scratch.keep(told.groupBy("label").agg(F.min("rep").alias("component_id")))
    told = scratch.keep(told.join(names, "label").select("vector", (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id"))
    scratch.only(told)
    return sound.join(told, "vector").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
