"""Two-table joins with a choice of strategy; every strategy gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import estimated_bytes

STRATEGIES = ("auto", "shuffle_hash", "merge", "broadcast", "semi_reduced")
THETA_STRATEGIES = ("nested_loop", "replicated", "ranges")
#: Estimated bytes up to which a side may be broadcast on request; beyond, the join is a merge join.
BROADCAST_BYTES = 256 << 20
#: Distinct keys up to which theta keys are replicated through a broadcast.
REPLICATED_KEYS = 10_000
#: Pairs of rows that a key may make in one task; a key with more is dealt over several.
PAIRS = 8_000_000
#: Pairs that a task of a nested-loop join tests.
TESTED = 64_000_000
#: Tasks that dealing asks for at most; beyond, each takes more chunks, one after the other.
TASKS = 20_000


def semi_filter(s: DataFrame, r: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of s whose key occurs in r."""
    keys = [key] if isinstance(key, str) else key
    return s.join(r.select(*keys).distinct(), keys, "left_semi")


def anti_filter(s: DataFrame, r: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of s whose key does not occur in r; duplicates stay, as when subtracting by key."""
    keys = [key] if isinstance(key, str) else key
    return s.join(r.select(*keys).distinct(), keys, "left_anti")


def _hot(r: DataFrame, s: DataFrame, keys: list[str], pairs: int) -> DataFrame | None:
    """(keys, _chunks, _copied) of the keys that make more than ``pairs`` pairs, None if there are none. Each stands for
    that many rows of the result, so they are few against it."""
    sides = r.select(*keys, F.lit(1).alias("_r"), F.lit(0).alias("_s")).unionByName(s.select(*keys, F.lit(0).alias("_r"), F.lit(1).alias("_s")))
    counted = sides.dropna(subset=keys).groupBy(*keys).agg(F.sum("_r").cast("double").alias("_r"), F.sum("_s").cast("double").alias("_s"))
    found = counted.where(F.col("_r") * F.col("_s") > pairs).select(*keys, F.ceil(F.col("_r") * F.col("_s") / pairs).alias("_chunks"), (F.col("_r") <= F.col("_s")).alias("_copied"))
    rows = found.collect()
    return r.sparkSession.createDataFrame(rows, found.schema) if rows else None


def _dealt_join(r: DataFrame, s: DataFrame, keys: list[str], hint: str, pairs: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """r joined with s by exchange. The larger side of a key that makes more than ``pairs`` pairs is dealt over chunks by a
    hash of its rows, to each of which the smaller side is copied, so no key has to be joined by one task; only exact
    copies of a row share a chunk. ``counted`` has the keys of s, if that is cheaper to read."""
    hot = _hot(r, s if counted is None else counted, keys, pairs or PAIRS)
    if hot is None:
        return r.hint(hint).join(s, keys)

    def dealt(df: DataFrame, copied: Column) -> DataFrame:
        hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
        own = F.pmod(F.xxhash64(*hashed), "_chunks")
        chunks = F.when(F.col("_chunks").isNull(), F.array(F.lit(0).cast("long"))).when(copied, F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).otherwise(F.array(own))
        out = df.join(F.broadcast(hot), keys, "left").withColumn("_chunk", F.explode(chunks)).drop("_chunks", "_copied")
        return out.repartition(tasks, *keys, "_chunk")

    chunks = hot.agg(F.sum("_chunks")).first()[0]
    tasks = min(TASKS, max(chunks, int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return dealt(r, F.col("_copied")).hint(hint).join(dealt(s, ~F.col("_copied")), [*keys, "_chunk"]).drop("_chunk")


def equi_join(r: DataFrame, s: DataFrame, key: str | list[str], strategy: str = "auto", pairs: int | None = None) -> DataFrame:
    """Inner join on ``key``; r's columns come first whatever side is built.

    shuffle_hash: both sides dealt by key, r built as a hash table. Keys that make more than ``pairs`` pairs, here and in
      merge joins, are counted first and dealt over several tasks.
    merge: both sides dealt by key and sorted, one side's group held at a time.
    broadcast: r sent to every task if its estimated size is within a bound, else merge.
    semi_reduced: rows of s without a match are dropped before the shuffle, then merge.
    """
    keys = [key] if isinstance(key, str) else key
    if strategy == "auto":
        return r.join(s, keys)
    if strategy in ("shuffle_hash", "merge"):
        return _dealt_join(r, s, keys, strategy, pairs)
    if strategy == "broadcast":
        return F.broadcast(r).join(s, keys) if estimated_bytes(r) <= BROADCAST_BYTES else _dealt_join(r, s, keys, "merge", pairs)
    if strategy == "semi_reduced":
        few = r.select(*keys).distinct()
        # Size of the whole of r bounds that of its keys.
        sent = F.broadcast(few) if estimated_bytes(r.select(*keys)) <= BROADCAST_BYTES else few
        return _dealt_join(r, s.join(sent, keys, "left_semi"), keys, "merge", pairs, s)
    raise ValueError(f"strategy is one of {STRATEGIES}")


def theta_join(r: DataFrame, s: DataFrame, r_key: str, s_key: str, strategy: str = "ranges", ranges: int = 64) -> DataFrame:
    """All columns of r, then of s, where r's key is greater than s's.

    nested_loop: every pair is tested, the smaller side broadcast, the other dealt evenly over tasks by the number of pairs;
      if neither is within the bound, ranges.
    replicated: each row of s is copied to every greater key of r, then an equi-join; for r with few distinct keys.
    ranges: keys are cut at quantiles of s; a row of s goes to its own range and those above, a row of r to its own
      range, where the predicate is tested. Shuffles s ``ranges`` / 2 times, tests hardly more pairs than match. A range
      with many pairs is dealt over several tasks.
    """
    if strategy == "nested_loop":
        sizes = estimated_bytes(r), estimated_bytes(s)
        if min(sizes) > BROADCAST_BYTES:
            return theta_join(r, s, r_key, s_key, "ranges", ranges)
        tasks = min(TASKS, -(-r.count() * s.count() // TESTED))
        if tasks > 1:  # a small table of few files makes few tasks, whatever it is joined to
            r, s = (r, s.repartition(tasks)) if sizes[0] <= sizes[1] else (r.repartition(tasks), s)
        r, s = (F.broadcast(r), s) if sizes[0] <= sizes[1] else (r, F.broadcast(s))
        return r.join(s, F.col(r_key) > F.col(s_key))
    if strategy == "replicated":
        keys = r.select(F.col(r_key).alias("_k")).where("_k is not null").distinct()
        if keys.limit(REPLICATED_KEYS + 1).count() > REPLICATED_KEYS:
            return theta_join(r, s, r_key, s_key, "ranges", ranges)
        copies = s.join(F.broadcast(keys), F.col("_k") > F.col(s_key))
        return r.join(copies, F.col(r_key) == F.col("_k")).drop("_k")
    if strategy == "ranges":
        cuts = sorted(set(s.approxQuantile(s_key, [i / ranges for i in range(1, ranges)], 0.001)))
        bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")

        def within(k: str):
            return F.size(F.filter(bounds, lambda b: b <= F.col(k).cast("double")))

        left = r.withColumn("_range", within(r_key)).where(F.col(r_key).isNotNull())
        right = s.where(F.col(s_key).isNotNull()).withColumn("_range", F.explode(F.sequence(within(s_key), F.lit(len(cuts)))))
        return equi_join(left, right, "_range", "shuffle_hash").where(F.col(r_key) > F.col(s_key)).drop("_range")
    raise ValueError(f"strategy is one of {THETA_STRATEGIES}")


def union_all(*tables: DataFrame) -> DataFrame:
    """Bag union by column name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
