"""Best-fit packing of token sequences with swap-based local search.

Documents are tokenised and cut into pieces of at most one sequence. Packing
needs only how many pieces there are of each length, at most 4,096 numbers, so
it is planned on this histogram: best-fit decreasing places whole length
classes at a time, bins of equal content are one pattern with a count, and the
number of patterns is bounded by the sequence length, not by the corpus. Then a
local search over all bins moves pieces or exchanges them one-for-one or
two-for-one wherever the sum of squared fills grows, bins of equal content at
once, until the count of bins is proved least by a lower bound or no exchange is
left between any two bins. Pieces take the plan's places by their rank within
their length, found in two levels so that no length class is ranked by one task.

Defined results: null text is the empty text, one end token; repeated rows and
null ids are pieces like any other; an empty table gives no rows; other columns
are ignored (with ``include_ids`` the token ids come along).
"""

from __future__ import annotations

import bisect
import heapq
import os
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .batches import BATCH, slices
from .common import Scratch

LENGTH = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces of one length that one task may rank; fewer where they would be more than a task's even share of all.
RANKED = 1_000_000

#: White space that is not ASCII's, and the start of special tokens: such texts are encoded whole.
_UNUSUAL = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
#: Words whose ids a worker remembers, about 110 MB.
_REMEMBERED = 500_000
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # of ASCII, without the apostrophe, which may begin a contraction
_LETTERS = "".join(filter(str.isalpha, map(chr, range(256))))  # of Latin-1
#: Byte-level models write a byte as itself if it is printable Latin-1, and the others from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}
_encoders: dict[str, Encoder] = {}


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False)


def _joined(parts: pa.ListArray, every: int) -> pa.ListArray:
    """Each ``every`` consecutive lists as one."""
    return pa.ListArray.from_arrays(pa.array(parts.offsets.to_numpy()[::every]), parts.values)


class Encoder:
    """Token ids as little-endian 32-bit numbers. Pre-tokens never span white space, so texts are split into words and the ids
    of each distinct word put in its places. Letters and the punctuation after them are pre-tokens of their own, so Latin words
    are looked up in lower case and without it; new ones go to the model without the text stages, which take most of the time
    for one word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        self.model = self.tokenizer.model

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _latin(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _looked_up(self, parts: pa.StringArray, latin: np.ndarray) -> pa.ListArray:
        """Ids of distinct parts; ``latin`` tells which are lower-case Latin letters."""
        names = parts.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, names))
        new = [i for i, x in enumerate(found) if x is None]
        rest = [i for i in new if not latin[i]]
        for i in new:
            if latin[i]:
                found[i] = self._latin(names[i])
        for i, x in zip(rest, self._whole([names[i] for i in rest]), strict=True):
            found[i] = x
        for i in new[: max(0, _REMEMBERED - len(self.known))]:
            self.known[names[i]] = found[i]
        ends = np.zeros(len(found) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4")))

    def encode(self, texts: list[str | None] | pa.StringArray) -> list[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        whole = pc.match_substring_regex(texts, _UNUSUAL)
        words = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
        placed = words.flatten().dictionary_encode()
        bases = pc.utf8_rtrim(placed.dictionary, _PUNCTUATION)
        marks = pc.utf8_ltrim(placed.dictionary, _LETTERS)
        latin = (_sizes(bases) > 0) & (_sizes(bases) + _sizes(marks) == _sizes(placed.dictionary))
        held = pa.array(latin)
        # Two parts of each distinct word: letters and punctuation, or the word as it is and nothing.
        parts = pa.concat_arrays([pc.if_else(held, pc.utf8_lower(bases), placed.dictionary), pc.if_else(held, marks, "")]).dictionary_encode()
        of, n = parts.indices.to_numpy(), len(latin)
        plain = np.zeros(len(parts.dictionary), bool)
        plain[of[:n][latin]] = True
        ids = _joined(self._looked_up(parts.dictionary, plain).take(pa.array(of.reshape(2, n).T.ravel())), 2).take(placed.indices)
        ends = ids.offsets.to_numpy()[words.offsets.to_numpy() - words.offsets[0].as_py()].astype(np.int64) * 4
        data = memoryview(ids.values.to_numpy()).cast("B")
        out = [bytes(data[lo:hi]) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        for i, x in zip(at, self._whole(texts.take(pa.array(at, pa.int64())).to_pylist()), strict=True):
            out[i] = x
        return out


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, vocabulary: str = VOCABULARY, include_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, cut every ``length`` tokens."""
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if include_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    tail, most = np.array([end_id], dtype="<u4").tobytes(), 4 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary)
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for batch in batches:
            for part in slices(batch, text):
                at, starts, sizes, sums, ids = [], [], [], [], []
                for i, data in enumerate(encoder.encode(part.column(1))):
                    data += tail
                    for start in range(0, len(data), most):
                        own = data[start : start + most]
                        at.append(i)
                        starts.append(start // 4)
                        sizes.append(len(own) // 4)
                        sums.append(zlib.crc32(own))
                        if include_ids:
                            ids.append(np.frombuffer(own, dtype="<i4"))
                out = [part.column(0).take(pa.array(at, pa.int64())), pa.array([s // length for s in starts], pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
                if include_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select(doc_id, text).mapInArrow(cut, schema)


def best_fit(counts: dict[int, int], length: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over length classes: (pieces of each length in a bin, number of such bins)."""
    free: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    rooms: list[int] = []  # sorted residuals that have bins

    def put(room: int, bin_: dict[int, int], n: int) -> None:
        if not free[room]:
            bisect.insort(rooms, room)
        free[room].append((bin_, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect.bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                bin_, n = free[room].pop()
                if not free[room]:
                    rooms.pop(k)
            else:
                room, bin_, n = length, {}, left
            each = min(room // size, left)
            filled = min(n, left // each)
            if n > filled and bin_:
                put(room, bin_, n - filled)
            put(room - each * size, bin_ | {size: each}, filled)
            left -= filled * each
    return [x for own in free.values() for x in own]


def least(counts: dict[int, int], length: int) -> int:
    """Martello and Toth's lower bound on the number of bins."""
    number, tokens = np.zeros(length + 2, np.int64), np.zeros(length + 2, np.int64)
    for s, n in counts.items():
        number[s + 1], tokens[s + 1] = n, n * s
    number, tokens, half = number.cumsum(), tokens.cumsum(), length // 2  # of pieces shorter than the index
    low = np.arange(half + 1)
    high = length - low + 1
    own = number[high] - number[half + 1]  # over half a bin, but leaving room for pieces of ``low``
    rest = tokens[half + 1] - tokens[low] - (own * length - tokens[high] + tokens[half + 1])
    return int((number[-1] - number[half + 1] + np.maximum(0, -(-rest // length))).max())


def _improve(bins: list[list[int]], length: int) -> list[list[int]]:
    """``exchanged`` over single bins."""
    out = exchanged([(dict(Counter(b)), 1) for b in bins], length)
    return [[s for s, k in bin_.items() for _ in range(k)] for bin_, n in out for _ in range(n)]


def exchanged(patterns: list[tuple[dict[int, int], int]], length: int) -> list[tuple[dict[int, int], int]]:
    """Local search: moves, one-for-one and two-for-one exchanges that increase the sum of squared fills empty bins, until the
    lower bound is reached or no exchange is left between any two bins. Equal bins take an exchange together.

    A bin a gives the piece x to b and takes pieces of b that sum to y < x. That is feasible and increases the sum if b's new
    room, its room + y - x, is at least 0 and below a's room. So b's exchanges are indexed by its room + y, and for each x the
    first of them from x on, whose y is below x, is the one that fills b most. A full bin has no such exchange."""
    done: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)  # full bins
    own: dict[tuple[tuple[int, int], ...], int] = {}  # number of the pattern, for those not full
    keys: list[tuple[tuple[int, int], ...]] = []
    copies: list[int] = []
    rooms: list[int] = []
    ends: list[list[int]] = []  # room + y of every exchange
    index: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # heaps of (y, pattern)
    first = np.full(length + 1, length + 1)  # least y in each
    sizes: dict[int, int] = defaultdict(int)

    def trim(end: int, out: int = -1) -> None:
        heap = index[end]
        while heap and (heap[0][1] == out or not copies[heap[0][1]]):
            heapq.heappop(heap)
        first[end] = heap[0][0] if heap else length + 1

    def offer(i: int) -> None:
        for end in ends[i]:
            heapq.heappush(index[end], (end - rooms[i], i))
            first[end] = index[end][0][0]

    def add(bin_: dict[int, int], n: int) -> None:
        key = tuple(sorted((s, k) for s, k in bin_.items() if k))
        room = length - sum(s * k for s, k in key)
        if not room:
            done[key] += n
        elif key in own and copies[own[key]]:
            copies[own[key]] += n
        elif key:
            own[key] = len(keys)
            keys.append(key)
            copies.append(n)
            rooms.append(room)
            pairs = {s + t for i, (s, k) in enumerate(key) for t, _ in key[i + (k < 2) :]}
            ends.append([room + y for y in {0, *(s for s, _ in key), *pairs}])
            offer(own[key])

    def remove(i: int, n: int) -> None:
        copies[i] -= n
        if not copies[i]:
            for end in ends[i]:
                if index[end] and index[end][0][1] == i:
                    trim(end)

    def step(a: int) -> int:
        """Makes the best exchange of pattern a; returns how many bins became empty, or -1 without one."""
        alone, best = copies[a] == 1, None
        if alone:  # a bin makes no exchange with itself
            lifted = [end for end in ends[a] if index[end] and index[end][0][1] == a]
            for end in lifted:
                trim(end, a)
        for x, _ in reversed(keys[a]):
            open_ = first[x : x + rooms[a]] < x
            at = int(open_.argmax())
            if open_[at]:
                y, b = index[x + at][0]
                if best is None or (at, y - x) < best[0]:
                    best = (at, y - x), b, x, y
        if alone:
            for end in lifted:
                heapq.heappush(index[end], (end - rooms[a], a))
                first[end] = index[end][0][0]
        if best is None:
            return -1
        _, b, x, y = best
        n = copies[a] // 2 if a == b else min(copies[a], copies[b])
        give, take = dict(keys[a]), dict(keys[b])
        back = [] if not y else [y] if y in take else next([s, y - s] for s in take if take.get(y - s, 0) > (2 * s == y))
        remove(b, n)
        remove(a, n)
        for s, bin_, other in [(x, give, take), *((s, take, give) for s in back)]:
            bin_[s] -= 1
            other[s] = other.get(s, 0) + 1
        add(give, n)
        add(take, n)
        return 0 if any(give.values()) else n

    for bin_, n in patterns:
        add(bin_, n)
        for s, k in bin_.items():
            sizes[s] += n * k
    spare, changed = sum(n for _, n in patterns) - least(sizes, length), True
    while spare > 0 and changed:
        changed = False
        for a in sorted((i for i, n in enumerate(copies) if n), key=lambda i: -rooms[i]):
            while spare > 0 and copies[a] and (emptied := step(a)) >= 0:
                spare, changed = spare - emptied, True
    return [(dict(k), n) for k, n in [*done.items(), *((keys[i], n) for i, n in enumerate(copies) if n)]]


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """Patterns with counts that place every piece of the histogram."""
    return exchanged(best_fit(counts, length), length)


def _segments(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length: rows of (first rank, first sequence, copies in a sequence, first offset), by rank."""
    ranks: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    sequence = 0
    for bin_, n in patterns:
        offset = 0
        for size in sorted(bin_, reverse=True):
            out[size].append((ranks[size], sequence, bin_[size], offset))
            ranks[size] += n * bin_[size]
            offset += size * bin_[size]
        sequence += n
    return {s: np.array(x, dtype=np.int64) for s, x in out.items()}


def pack(cut: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """``cut`` (written pieces with a column ``length``) with ``sequence_id`` and ``offset``."""
    ship(cut.sparkSession)
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length
    segments = _segments(plan(sizes, length))
    most = max(1, min(RANKED, sum(sizes.values()) // int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    split = {s: -(-n // most) for s, n in sizes.items() if n > most}
    chunks = F.get(F.split(F.lit(",".join(str(split.get(s, 1)) for s in range(length + 1))), ",").cast("array<int>"), F.col("length").cast("int"))
    keyed = cut.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), chunks))
    starts: dict[tuple[int, int], int] = {}
    run: dict[int, int] = defaultdict(int)
    if split:  # one row for each length and chunk
        for r in keyed.groupBy("length", "_chunk").agg(F.count("*").alias("n")).orderBy("length", "_chunk").collect():
            starts[r["length"], r["_chunk"]] = run[r["length"]]
            run[r["length"]] += r["n"]
    order = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(order) - 1)
    names, schema = cut.columns, T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, chunk, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "_chunk", "_rank"))
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size).tolist():
                own = np.flatnonzero(size == s)
                r = rank[own] + (np.array([starts[s, c] for c in chunk[own].tolist()], dtype=np.int64) if starts else 0)
                g = segments[s]
                k = np.searchsorted(g[:, 0], r, side="right") - 1
                row, inside = g[k], r - g[k, 0]
                sequence[own], offset[own] = row[:, 1] + inside // row[:, 2], row[:, 3] + inside % row[:, 2] * s
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(settle, schema)


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, vocabulary: str = VOCABULARY, include_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).
    Token ids take no part in ranking and placing; they are joined to the placed pieces at the end."""
    scratch = Scratch(docs.sparkSession)
    cut = pieces(docs, doc_id=doc_id, text=text, length=length, end_id=end_id, vocabulary=vocabulary, include_ids=include_ids)
    if not include_ids:
        return pack(scratch.keep(cut, BATCH), length=length)
    cut = scratch.keep(cut.withColumn("row", F.monotonically_increasing_id()), BATCH)
    placed = scratch.keep(pack(cut.drop("ids"), length=length))
    return placed.join(cut.select("row", "ids"), "row").drop("row")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths) of pieces placed with their ids: each sequence whole, and the lengths of its pieces in order."""
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))  # one sequence at most
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
