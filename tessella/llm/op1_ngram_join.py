"""N-gram Jaccard join with adaptive multi-match prefixes.

Equal shingle sets are one entity. Shingles are ordered by their fingerprint;
with overlap at least T required of a set of n, any partner shares at least l
shingles with its first n - T + l (the l-prefix), for every l up to T. Each
document picks its own l: it lengthens the prefix while the estimated cost of
the candidates falls, counting posting lists to scan and pairs to verify, and
requires correspondingly more shared shingles. Shingles whose lists join too
many documents of different components ("hot") are never scanned: a prefix with
h of them still needs l - h matches among the others, so a document lengthens
its prefix until l > h. For a pair the shorter l of the two counts, and the
sizes of both raise the matches it needs.

Order of work, all on distributed tables:

1. shingle every text; group equal sets.
2. join near copies early: sets that share a minimum hash under one of two
   permutations meet in blocks of bounded size and are compared there; only
   edges of a spanning forest come out. So a family of near copies is one
   component before candidates are counted, and pairs inside a component, which
   cannot change the result, are never made.
3. candidates as above. Documents whose allowance of extra prefix holds too many
   hot shingles are tried again among themselves with their whole sets; those
   still left, made of hot shingles almost entirely, are compared in blocks of
   the lists of their prefixes, again without pairs coming out. No link is lost.
4. exact verification of the candidates on whole texts, and components.

Defined results
- null or blank text: an empty set, linked with nothing, its own component.
- null id: the row comes back with component_id null and links with nothing.
- rows that repeat an id: each comes back; a set takes the smallest of its ids.
- empty table: no rows. Other columns are ignored.
- sets and shingles are identified by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .batches import BATCH, slices
from .common import Scratch, broadcast_if, content_key, dropping, nested, unnested
from .components import components
from .shingles import mixed, shingle_sets

WORDS, PERCENT = 5, 80
#: Average partners of other components that a scanned list may give each of its documents.
HOT = 64
#: Extra prefix that documents may take in the first round, as a share of their shingles.
EXTRA = 0.06
#: Cost of verifying a pair, in postings scanned.
VERIFY = 30
BLOCK = 96
#: Sets in a block of a hot list; larger blocks copy a set to fewer of them.
DENSE_BLOCK = 512
#: Shingles in a block of either kind, on average: blocks of long sets have fewer sets.
BLOCK_SHINGLES = 1 << 20
#: Shingles whose matrix is made at a time when sets are compared.
_RANGE = 1 << 19
#: Rows of (document, few numbers) that may be broadcast; about 50 bytes each.
BROADCAST_ROWS = 500_000
_SEEDS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))
_ALL = 2**30


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _fingerprint(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _members(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, sid, k0, k1): size, fingerprint and two minimum hashes of each document's set; null fingerprints for empty sets.
    Columns of ``docs`` besides id and text follow."""
    more = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(_column(part, "text"), k)
                sizes = [len(s) for s in sets]
                sid = [_fingerprint(s) if len(s) else None for s in sets]
                least = [[int(mixed(s ^ seed).min().view(np.int64)) if len(s) else None for s in sets] for seed in _SEEDS]
                yield pa.RecordBatch.from_arrays([_column(part, "doc_id"), pa.array(sizes, pa.int64()), pa.array(sid, pa.int64()), *(pa.array(x, pa.int64()) for x in least), *(_column(part, f.name) for f in more)], names=["doc_id", "n", "sid", "k0", "k1", *(f.name for f in more)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, ", ".join([f"doc_id {kind}, n long, sid long, k0 long, k1 long", *(f"{f.name} {f.dataType.simpleString()}" for f in more)]))


def _postings(docs: DataFrame, k: int, percent: int, extra: float | None, least: int) -> DataFrame:
    """(sid, n, token, level): a shingle's level is the least l whose prefix holds it. ``extra`` None: of the whole set.
    Where ``docs`` says which ``sid`` is meant, another text of a repeated id is left out."""
    meant = "sid" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sids, sizes, tokens, levels = [], [], [], []
                found = shingle_sets(_column(part, "text"), k)
                for s, due in zip(found, _column(part, "sid").to_pylist() if meant else [None] * len(found), strict=True):
                    n = len(s)
                    if n < least or (sid := _fingerprint(s)) in seen or meant and sid != due:
                        continue
                    seen.add(sid)
                    need = (percent * n + 99) // 100
                    upto = n if extra is None else min(n, n - need + int(np.ceil(extra * n)) + 1)
                    sids.append(sid)
                    sizes.append(n)
                    tokens.append(_signed(s[:upto]))
                    levels.append(np.maximum(1, np.arange(1, upto + 1) - (n - need)).astype(np.int32))
                if sids:
                    count = [len(t) for t in tokens]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sids, count)), pa.array(np.repeat(np.array(sizes, np.int32), count)), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(levels))], names=["sid", "n", "token", "level"])

    return docs.select("text", *["sid"] * meant).mapInArrow(run, "sid long, n int, token long, level int")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of intersections, summed over ranges of shingles: bounded memory, however long the texts."""
    g = len(sets)
    common = np.zeros((g, g), dtype=np.int64)
    ranges = 1 + sum(len(s) for s in sets) // _RANGE
    cuts = [np.uint64(2**64 * r // ranges) for r in range(1, ranges)]
    bounds = [np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]]).astype(np.int64) if ranges > 1 else (0, len(s)) for s in sets]
    for r in range(ranges):
        own = [s[b[r] : b[r + 1]] for s, b in zip(sets, bounds, strict=True)]
        values, column = np.unique(np.concatenate(own), return_inverse=True)
        row = np.repeat(np.arange(g), [len(s) for s in own])
        shared = np.bincount(column, minlength=len(values)) > 1
        number = np.cumsum(shared) - 1
        row, column = row[shared[column]], number[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(column, [lo, lo + 4096])
            dense = np.zeros((g, min(4096, int(column[b - 1]) - lo + 1)), dtype=np.float32)
            dense[row[a:b], column[a:b] - lo] = 1
            common += (dense @ dense.T).astype(np.int64)
    return common


def _linked(sets: list[np.ndarray], percent: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Matrix of the pairs, among the ``wanted`` ones, whose Jaccard similarity is at least ``percent``."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    whole = sizes[:, None] + sizes[None, :]
    if wanted is None or wanted.sum() * 8 > len(sets) ** 2:
        common = _common(sets)
        near = 100 * common >= percent * (whole - common)
        return near if wanted is None else near & wanted
    near = np.zeros_like(wanted)
    for i, j in zip(*np.nonzero(np.triu(wanted, 1)), strict=True):
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        near[i, j] = near[j, i] = 100 * both >= percent * (sizes[i] + sizes[j] - both)
    return near


def _forest(sids: list[int], links: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each component's least set to its others."""
    root = np.arange(len(sids))
    for i in range(len(sids)):
        near = np.unique(np.append(root[np.flatnonzero(links[i])], root[i]))
        if len(near) > 1:
            root[np.isin(root, near)] = near[0]
    out = []
    for r in np.unique(root):
        own = sorted(sids[i] for i in np.flatnonzero(root == r))
        out += [(own[0], x) for x in own[1:]]
    return out


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted's columns, text) for a written table of (rep, ...), by id: texts are shuffled only if ``wanted`` is too long to broadcast."""
    return docs.join(broadcast_if(wanted, BROADCAST_ROWS), docs["doc_id"] == wanted["rep"]).drop("doc_id", "rep")


def _groups(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[dict], list[np.ndarray]]]:
    """(rows, sets) of each run of rows with one ``block``; of those with one ``sid``, the first whose text has it."""
    at, rows, sets, seen = None, [], [], set()
    for batch in batches:
        for part in slices(batch, "text"):
            found = shingle_sets(_column(part, "text"), k)
            rest = part.drop_columns(["text"]).to_pylist()
            for row, s in zip(rest, found, strict=True):
                if row["block"] != at:
                    if len(rows) > 1:
                        yield rows, sets
                    at, rows, sets, seen = row["block"], [], [], set()
                if row["sid"] not in seen and _fingerprint(s) == row["sid"]:  # a repeated id may bring another text
                    seen.add(row["sid"])
                    rows.append(row)
                    sets.append(s)
    if len(rows) > 1:
        yield rows, sets


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _early(docs: DataFrame, sets: DataFrame, scratch: Scratch, k: int, percent: int, block: int) -> DataFrame:
    """Edges (a, b) of near copies that share a minimum hash, compared in blocks of about ``block`` sets."""
    keys = sets.select("sid", "rep", "n", F.posexplode(F.array("k0", "k1")).alias("j", "key"))
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    # Written, so that a join on a key that many sets share can be split.
    groups = scratch.keep(keys.groupBy("j", "key").agg(F.count("*").alias("c"), parts.alias("parts")).where("c > 1").drop("c"))
    met = keys.join(broadcast_if(groups, BROADCAST_ROWS), ["j", "key"]).select("sid", "rep", F.xxhash64("j", "key", F.pmod(F.xxhash64("sid"), F.col("parts"))).alias("block"))
    met = scratch.keep(met)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in _groups(batches, k):
            edges = _forest([r["sid"] for r in rows], _linked(own, percent))
            if edges:
                yield _edges(edges)

    rows = _texts(docs, met).select("block", "sid", "text").repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(run, "a long, b long")


def _dense(docs: DataFrame, sets: DataFrame, postings: DataFrame, left: DataFrame, comps: DataFrame, scratch: Scratch, k: int, percent: int, block: int) -> DataFrame:
    """Edges (a, b) that join components among the sets of ``left``, which hardly have a shingle that is not hot.

    Every list of a 1-prefix shingle is compared block by block, each pair under the first shingle that both prefixes
    hold; only edges come out, never pairs.
    """
    own = postings.where("level = 1").join(left, "sid", "left_semi").select("sid", "n", "token")
    own = own.join(broadcast_if(comps, BROADCAST_ROWS), own["sid"] == comps["node"], "left").select("sid", "n", "token", F.coalesce("label", "sid").alias("comp"))
    own = scratch.keep(own)
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    lists = own.groupBy("token").agg(parts.alias("blocks"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").drop("x", "y")
    met = own.join(broadcast_if(scratch.keep(lists), BROADCAST_ROWS), "token").withColumn("half", F.pmod(F.xxhash64("sid"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("sid", "comp", "token", "half", F.xxhash64("token", F.least("half", "other"), F.greatest("half", "other")).alias("block"))
    texts = _texts(docs, scratch.keep(left.join(sets.select("sid", "rep"), "sid").select("sid", "rep"))).select("sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in _groups(batches, k):
            comp, half = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("comp", "half"))
            wanted = comp[:, None] != comp[None, :]
            if len(np.unique(half)) > 1:
                wanted &= half[:, None] != half[None, :]
            sizes = np.array([len(s) for s in own])
            wanted &= np.minimum(sizes[:, None], sizes[None, :]) * 100 >= np.maximum(sizes[:, None], sizes[None, :]) * percent
            token = np.array([rows[0]["token"]], dtype=np.int64).view(np.uint64)[0]
            before = []
            for s in own:
                prefix = s[: len(s) - (percent * len(s) + 99) // 100 + 1]
                before.append(prefix[prefix < token])
            wanted &= _common(before) == 0 if any(len(p) for p in before) else True
            edges = _forest([r["sid"] for r in rows], _linked(own, percent, wanted)) if wanted.any() else []
            if edges:
                yield _edges(edges)

    rows = met.join(texts, "sid").select("block", "sid", "comp", "token", "half", "text").repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(run, "a long, b long")


def _choose(levels: np.ndarray, costs: np.ndarray, hot: np.ndarray, most: int, percent: int) -> tuple[int, int] | None:
    """(l, matches needed) of least estimated cost, or None if no l within ``most`` exceeds its hot shingles."""
    order = np.argsort(levels, kind="stable")
    levels, costs, hot = levels[order], costs[order], hot[order]
    ls = np.unique(np.minimum(np.concatenate([[1], levels, np.cumsum(np.ones(24, dtype=np.int64)), np.linspace(1, most, 24).astype(np.int64)]), most))
    upto = np.searchsorted(levels, ls, side="right")
    heat = np.concatenate([[0], np.cumsum(hot)])[upto]
    scan = np.concatenate([[0.0], np.cumsum(np.where(hot, 0, costs))])[upto]
    need = ls - heat
    if not (need > 0).any():
        return None
    cost = np.where(need > 0, scan + VERIFY * scan / np.maximum(need, 1), np.inf)
    best = int(np.argmin(cost))
    return int(ls[best]), int(need[best])


def _round(postings: DataFrame, comps: DataFrame, scratch: Scratch, percent: int, limit: int, extra: float | None) -> tuple[DataFrame, DataFrame]:
    """(pairs to verify, sets left for the next round) among the sets of ``postings``."""
    # Most shingles are in one set only. They are dropped first, so that little more than the fingerprints is shuffled for them.
    # What a join reads of a common shingle can be split, because the other side is a written table.
    several = scratch.keep(postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"))
    own = scratch.keep(postings.join(several, "token").select("sid", "n", "token", "level"))
    marked = own.join(broadcast_if(comps, BROADCAST_ROWS), own["sid"] == comps["node"], "left")
    marked = marked.select("sid", "n", "token", "level", F.coalesce("label", "sid").alias("comp"))
    sums = marked.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token")
    stats = sums.agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count("*").alias("comps"), F.max_by("comp", "c").alias("main")).where("comps > 1")
    # Average partners in other components. Scans skip the main component on one side, so they visit at most this many.
    stats = stats.select("token", ((F.col("all") * F.col("all") - F.col("same")) / F.col("all")).alias("cost"), "main")
    stats = scratch.keep(stats)
    held = marked.join(stats, "token").select("sid", "n", "comp", F.struct("token", "level", "cost", (F.col("comp") == F.col("main")).alias("main")).alias("p"))
    held = held.groupBy("sid", "n", "comp").agg(F.collect_list("p").alias("ps"))  # at most a document's own shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _column(batch, "ps")
            flat, size = lists.flatten(), lists.value_lengths().to_numpy()
            token, level, cost, main = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            sid, n, comp = (_column(batch, c).to_numpy() for c in ("sid", "n", "comp"))
            ell, need, use = np.full(len(sid), _ALL, np.int32), np.zeros(len(sid), np.int32), np.zeros(len(token), bool)
            for i, end in enumerate(np.cumsum(size).tolist()):
                s = slice(end - int(size[i]), end)
                hot = cost[s] > limit
                most = (percent * int(n[i]) + 99) // 100 if extra is None else max(1, int(0.01 * percent * extra * int(n[i])))
                ell[i], need[i] = _choose(level[s].astype(np.int64), cost[s], hot, most, percent) or (_ALL, 0)
                use[s] = ~hot & (level[s] <= ell[i])
            row = np.repeat(np.arange(len(sid)), size)[use]
            bare = np.flatnonzero((ell == _ALL) & (np.bincount(row, minlength=len(sid)) == 0))  # left for the next round
            at, none = np.concatenate([row, bare]), len(bare)
            columns = [np.concatenate([token[use], np.zeros(none, np.int64)]), sid[at], comp[at], n[at], np.concatenate([level[use], np.zeros(none, np.int32)]), ell[at], need[at], np.concatenate([main[use].astype(bool), np.zeros(none, bool)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "sid", "comp", "n", "level", "ell", "need", "main"])

    chosen = scratch.keep(held.mapInArrow(run, "token long, sid long, comp long, n int, level int, ell int, need int, main boolean"), BATCH)
    left = scratch.keep(chosen.where(F.col("ell") == _ALL).select("sid").distinct())
    r, s = chosen.where("level > 0").alias("r"), chosen.where("level > 0 and not main").alias("s")
    small, large = F.least("r.n", "s.n"), F.greatest("r.n", "s.n")
    meet = (
        (F.col("r.token") == F.col("s.token"))
        & (F.col("r.comp") != F.col("s.comp"))
        & (F.col("r.main") | (F.col("r.sid") < F.col("s.sid")))
        & (small * 100 >= large * percent)
        & (F.col("r.level") <= F.col("s.ell"))
        & (F.col("s.level") <= F.col("r.ell"))
        & (F.least("r.ell", "s.ell") < _ALL)
    )
    # What the document with the shorter l needs, raised by what both sizes need beyond either alone.
    fewer = F.when(F.col("r.ell") < F.col("s.ell"), F.col("r.need")).when(F.col("s.ell") < F.col("r.ell"), F.col("s.need")).otherwise(F.greatest("r.need", "s.need"))
    both = F.floor((percent * (small + large) + (99 + percent)) / (100 + percent))
    raised = fewer + both - F.floor((large * percent + 99) / 100)
    found = r.join(s, meet).select(F.least("r.sid", "s.sid").alias("a"), F.greatest("r.sid", "s.sid").alias("b"), raised.alias("needed"))
    pairs = found.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("needed").alias("needed")).where("c >= needed").select("a", "b")
    pairs = scratch.keep(pairs)
    scratch.free(several, own, stats, chosen)
    return pairs, left


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """The pairs that are similar enough, by their whole texts."""
    wanted = pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct()
    wanted = scratch.keep(wanted.join(sets.select("sid", "rep"), F.col("w") == F.col("sid")).select("sid", "rep"))
    texts = _texts(docs, wanted).select("sid", "text")
    one, other = texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", "text_b"):
                keep = []
                for a, b, x, y in zip(_column(part, "a").to_pylist(), _column(part, "b").to_pylist(), shingle_sets(_column(part, "text_a"), k), shingle_sets(_column(part, "text_b"), k), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both) and _fingerprint(x) == a and _fingerprint(y) == b)
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    joined = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def similarity_components(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, extra: float = EXTRA, block: int = BLOCK, dense_block: int = DENSE_BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _labelled(docs, words, percent, hot, extra, block, dense_block).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hot: int = HOT, extra: float = EXTRA, block: int = BLOCK, dense_block: int = DENSE_BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, label) for every row of (doc_id, text, ...), and its other columns.
    Unlike the id, which may have several texts, the label stands for one component; null for empty sets."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    besides = [c for c in docs.columns if c not in ("doc_id", "text")]
    members = scratch.keep(_members(docs, words), BATCH)
    docs = docs.select("doc_id", "text")
    sets = members.where("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("k0").alias("k0"), F.max("k1").alias("k1"))
    sets = scratch.keep(sets)
    # Sets smaller than this link with equal ones only.
    least = -(-percent // (100 - percent)) if percent < 100 else _ALL
    wide = sets.where(F.col("n") >= least)
    edges = scratch.keep(_early(docs, wide, scratch, words, percent, block), BATCH)
    comps = scratch.keep(components(edges, scratch))
    copies = members.where("sid is not null").select("doc_id").join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    copies = scratch.keep(copies.where("doc_id is not null").distinct())
    ones = docs.where("doc_id is not null").join(broadcast_if(copies, BROADCAST_ROWS), "doc_id", "left_anti")
    postings = scratch.keep(_postings(ones, words, percent, extra, least), BATCH)
    pairs, left = _round(postings, comps, scratch, percent, hot, extra)
    scratch.free(postings)
    closer = edges
    if left.count():  # the length of a written table
        again = _texts(docs, scratch.keep(left.join(sets.select("sid", "rep"), "sid").select("sid", "rep")))
        postings = scratch.keep(_postings(again, words, percent, None, least), BATCH)
        more, left = _round(postings, comps, scratch, percent, hot, None)
        pairs = scratch.keep(pairs.unionByName(more).distinct())
        if left.count():
            closer = edges.unionByName(scratch.keep(_dense(docs, sets, postings, left, comps, scratch, words, percent, dense_block), BATCH))
    links = scratch.keep(_verified(docs, sets, pairs, scratch, words, percent), BATCH)
    final = scratch.keep(components(closer.unionByName(links), scratch)).select(F.col("node").alias("sid"), "label")
    labelled = scratch.keep(sets.join(final, "sid", "left").select("sid", "rep", F.coalesce("label", "sid").alias("label")))
    least_ids = scratch.keep(labelled.groupBy("label").agg(F.min("rep").alias("component_id")))
    ids = scratch.keep(labelled.join(least_ids, "label").select("sid", "component_id", "label"))
    scratch.only(members, ids)
    out = members.join(broadcast_if(ids, BROADCAST_ROWS), "sid", "left")
    own = F.when(F.col("sid").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "label", *besides)


def one_of_each(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that a chain of links joins to a document of smaller id; rows that repeat a kept id with a
    linked text go, too. Where an id has several texts, each goes or stays by its own links."""
    scratch, row = Scratch(docs.sparkSession), ["doc_id", "content_a", "content_b"]
    keys = {"doc_id": F.col(doc_id)} | dict(zip(row[1:], content_key(F.col(text)), strict=True))
    with dropping():
        found = scratch.keep(_labelled(docs.select(F.col(text).alias("text"), *[c.alias(k) for k, c in keys.items()]), words, percent))
    goes = scratch.keep(found.where("component_id <> doc_id").select(*row).distinct())
    kept = nested(docs, **keys).join(broadcast_if(goes, BROADCAST_ROWS), row, "left_anti")
    stay = found.where("component_id = doc_id")
    many = stay.groupBy("doc_id", "label").count().where("count > 1").select(F.col("doc_id").alias("i"), F.col("label").alias("l"))
    if many.limit(1).count():
        many = stay.join(many, (F.col("doc_id") == F.col("i")) & F.col("label").eqNullSafe(F.col("l"))).select(*row, "label", F.lit(True).alias("many")).distinct()
        told = kept.join(broadcast_if(scratch.keep(many), BROADCAST_ROWS), row, "left")
        kept = told.where("many is null").select("row").unionByName(told.where("many").dropDuplicates(["doc_id", "label"]).select("row"))
    return kept.select(*unnested(docs))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return similarity_components(docs, words=3, percent=90)
