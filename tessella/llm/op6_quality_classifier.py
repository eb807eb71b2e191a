"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in statistics of its whole text: shares of byte
classes, of distinct words and of distinct windows, smoothed for short texts and
squashed to a common scale. Preference pairs put a document labelled 1 over one
labelled 0; the weights minimise logistic loss on feature differences. The
cutoff is the quantile of the training scores at the share of label 0, and the
logistic of a strength's distance from it, moved so that the cutoff reads 0.7,
is the score.

The model is fitted on all labelled rows outside the held-out fold and on all
pairs of them. The loss of a pair depends on two strengths only and is analytic,
so that sums over pairs follow from sums over documents: Chebyshev moments of
the strengths in cells of width 1, with the statistics and their products. What
the driver gets grows with the range of the strengths, not with the table, and
the sums are those of every pair to about 13 digits. The quantile is exact, by
counting the digits of the strengths. Texts are read once, a few megabytes at a
time (a longer text by itself); their statistics are a table.

Defined results: null text is the empty text, scored like any other; null
labels are ignored, any label above 0 counts as 1; without both labels in the
training fold every score is 0.7; a null id is in fold crc32(''); repeated rows
come back; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .batches import BATCH, slices
from .common import Scratch, broadcast_if
from .shingles import shingle_sets

CUTOFF = 0.7
RIDGE = 1e-4
FOLDS, HELD_OUT = 4, 2
#: Chebyshev moments of a cell; the pairwise loss has its nearest pole 3.14 off, so 12 of them leave 1e-13.
MOMENTS = 12
#: Largest change of a weight at which Newton's method has converged; its error is the square of that.
STEP = 1e-6
#: Tasks over the training rows at most, as each sends its sums to the driver, and rows that the labels may have in a broadcast.
_TASKS, _BROADCAST = 16, 1_000_000

# Byte classes that are counted.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&<>",
    "bar": b"|",
    "mark": b"!?",
    "stop": b".,;:",
    "other": b"=+-_/\\~^@{}[]()\"'`",
    "line": b"\n",
}
_TABLES = np.zeros((len(_CLASSES), 256), dtype=np.int64)
for _i, _c in enumerate(_CLASSES.values()):
    _TABLES[_i, list(_c)] = 1
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers between 0 and 1 for each text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    counts, words = np.zeros((n, len(_CLASSES))), np.zeros(n)
    for i in range(n):  # one text at a time, so that memory follows the longest text
        own = data[offsets[i] : offsets[i + 1]]
        bins = np.bincount(own, minlength=256)
        counts[i] = _TABLES @ bins
        word = ~_SPACES[own]
        words[i] = np.count_nonzero(word[1:] & ~word[:-1]) + (len(own) > 0 and bool(word[0]))
    size = np.diff(offsets).astype(float)
    one = np.array([len(s) for s in shingle_sets(texts, 1)], dtype=float)
    three = np.array([len(s) for s in shingle_sets(texts, 3)], dtype=float)
    share = counts / (size + 40.0)[:, None]
    windows = np.maximum(words - 2, np.minimum(words, 1))
    rows = [
        *(1.0 - np.exp(-share[:, i] * k) for i, k in enumerate((12, 12, 40, 60, 60, 10, 12, 40))),
        (one + 15.0) / (words + 15.0),
        (three + 15.0) / (windows + 15.0),
        np.log1p(one) / np.log1p(np.maximum(words, 1.0)) * (words > 0),
        np.clip((size / np.maximum(words, 1.0) - 4.0) / 10.0, 0, 1),
        np.clip(np.log1p(size / (counts[:, 7] + 1.0)) / 12.0, 0, 1),
        np.clip(np.log1p(words) / 12.0, 0, 1),
    ]
    return np.stack(rows, axis=1)


def strengths(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Summed in one order, so that a row has the same strength in every batch."""
    out = np.zeros(len(x))
    for k, w in enumerate(weights):
        out += x[:, k] * w
    return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


Loss = tuple[float, np.ndarray, np.ndarray]  # value, slope and curvature
Sums = dict[tuple[int, int], np.ndarray]


def _minimise(loss: Callable[[np.ndarray], Loss], n: int) -> np.ndarray:
    """Newton's method on a convex loss with a ridge; steps are halved until they do not increase it. The weights are rounded,
    so that the order of summation does not show."""
    w = np.zeros(n)
    value, slope, curve = loss(w)
    while True:
        move = np.linalg.solve(curve + RIDGE * np.eye(n), slope + RIDGE * w)
        move *= min(1.0, 10.0 / max(1e-9, float(np.abs(move).max())))
        while np.abs(move).max() >= STEP:
            tried = w - move
            new = loss(tried)
            if new[0] + RIDGE / 2 * tried @ tried <= value + RIDGE / 2 * w @ w + 1e-13:
                break
            move /= 2
        else:
            return np.round(w - move, 9)
        w, (value, slope, curve) = tried, new


def _drawn_loss(d: np.ndarray, w: np.ndarray) -> Loss:
    """Mean over given pairs with feature differences ``d``."""
    z = d @ w
    p = _logistic(-z)
    return float(np.logaddexp(0, -z).mean()), -(d * p[:, None]).mean(axis=0), (d * (p * (1 - p))[:, None]).T @ d / len(d)


def _add_moments(sums: Sums, x: np.ndarray, label: np.ndarray, w: np.ndarray) -> None:
    """Adds rows to the sums of each (label, cell): Chebyshev polynomials of the strength times 1, x and the products of x."""
    if not len(x):
        return
    u = strengths(x, w)
    cell = np.floor(u)
    t = 2 * (u - cell) - 1
    powers = np.polynomial.chebyshev.chebvander(t, MOMENTS - 1)
    i, j = np.triu_indices(x.shape[1])
    terms = np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])
    order = np.lexsort((cell, label))
    starts = np.flatnonzero(np.r_[True, (np.diff(cell[order]) != 0) | (np.diff(label[order]) != 0)])
    for own in np.split(order, starts[1:]):
        key = int(label[own[0]]), int(cell[own[0]])
        sums[key] = sums.get(key, 0) + powers[own].T @ terms[own]


def _all_pairs_loss(sums: Sums, n: int) -> Loss:
    """Mean over all pairs of a row labelled 1 and one labelled 0."""
    at = np.cos(np.pi * (np.arange(MOMENTS) + 0.5) / MOMENTS)  # Chebyshev's nodes
    spread = np.polynomial.chebyshev.chebvander(at, MOMENTS - 1) * 2 / MOMENTS  # from moments to weights of the nodes
    spread[:, 0] /= 2
    sides = []
    for side in (1, 0):
        cells = sorted(c for own, c in sums if own == side)
        rows = sum(sums[side, c][0, 0] for c in cells)
        sides.append((cells, [spread @ sums[side, c] / rows for c in cells]))
    (good, ours), (bad, theirs) = sides
    v, b = np.concatenate([c + (at + 1) / 2 for c in bad]), np.concatenate(theirs)
    value, slope, upper, cross, met = 0.0, np.zeros(n), np.zeros(b.shape[1] - n - 1), np.zeros((n, n)), np.zeros(len(v))
    for c, g in zip(good, ours, strict=True):
        z = v[None, :] - (c + (at + 1) / 2)[:, None]
        p = _logistic(z)
        q = p * (1 - p)
        value += g[:, 0] @ np.logaddexp(0, z) @ b[:, 0]
        slope += g[:, 0] @ (p @ b[:, 1 : n + 1]) - (p @ b[:, 0]) @ g[:, 1 : n + 1]
        upper += (q @ b[:, 0]) @ g[:, n + 1 :]
        met += g[:, 0] @ q
        cross += g[:, 1 : n + 1].T @ (q @ b[:, 1 : n + 1])
    curve = np.zeros((n, n))
    curve[np.triu_indices(n)] = upper + met @ b[:, n + 1 :]
    return float(value), slope, curve + np.triu(curve, 1).T - cross - cross.T


def _quantile(at: float, n: int, ranked: Callable[[list[int]], list[float]]) -> float:
    """The quantile by linear interpolation, from the values of ranks."""
    place = at * (n - 1)
    k = int(place)
    low, high = ranked([k, min(k + 1, n - 1)])
    return low + (high - low) * (place - k)


def _cutoff(bad: int, n: int, ranked: Callable[[list[int]], list[float]]) -> float:
    share = bad / n
    return (_quantile(max(0.0, share - 0.002), n, ranked) + _quantile(min(1.0, share + 0.002), n, ranked)) / 2


class Ranking:
    """Weights, scale and cutoff of fitted strengths."""

    def __init__(self, weights: np.ndarray, cutoff: float):
        self.weights, self.cutoff = weights, cutoff

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray, pairs: int | None = None, seed: int = 3) -> Ranking | None:
        """From rows in memory: all pairs of them or, for comparison, so many drawn ones."""
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        if not len(good) or not len(bad):
            return None

        def loss(w: np.ndarray) -> Loss:
            sums: Sums = {}
            _add_moments(sums, x, label, w)
            return _all_pairs_loss(sums, x.shape[1])

        if pairs is not None:
            rng = np.random.default_rng(seed)
            d = x[good[rng.integers(len(good), size=pairs)]] - x[bad[rng.integers(len(bad), size=pairs)]]
        w = _minimise(loss if pairs is None else lambda w: _drawn_loss(d, w), x.shape[1])
        u = np.sort(strengths(x, w))
        return cls(w, _cutoff(len(bad), len(label), lambda ranks: u[ranks].tolist()))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(strengths(x, self.weights) - self.cutoff + np.log(CUTOFF / (1 - CUTOFF)), -40, 40)
        return 1.0 / (1.0 + np.exp(-z))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def measure(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, x): the statistics of every row's whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column(2))
                ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], names=["doc_id", "held_out", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id)) == HELD_OUT).alias("held_out"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {kind}, held_out boolean, x array<double>")


def _moments(rows: DataFrame, w: np.ndarray) -> Sums:
    """Sums of ``_add_moments`` over a table (label, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Sums = {}
        for batch in batches:
            _add_moments(sums, _matrix(batch.column(1)), batch.column(0).to_numpy(), w)
        for (label, cell), m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([cell], pa.int64()), pa.array([m.tobytes()], pa.binary())], names=["label", "cell", "m"])

    parts = defaultdict(list)
    for r in rows.mapInArrow(run, "label int, cell long, m binary").toArrow().to_pylist():
        parts[r["label"], r["cell"]].append(r["m"])
    return {k: sum(np.frombuffer(m).reshape(MOMENTS, -1) for m in sorted(own)) for k, own in sorted(parts.items())}


def _ranked(rows: DataFrame, w: np.ndarray, ranks: list[int]) -> list[float]:
    """The strengths of given ranks, from 0, found by 16 bits of their order-preserving integers at a time."""
    sign = np.uint64(1 << 63)
    heads, left = [0] * len(ranks), list(ranks)
    for shift in (48, 32, 16, 0):
        wanted = sorted(set(heads))

        def run(batches: Iterator[pa.RecordBatch], shift: int = shift, wanted: list[int] = wanted) -> Iterator[pa.RecordBatch]:
            counts = {h: np.zeros(1 << 16, np.int64) for h in wanted}
            for batch in batches:
                bits = (strengths(_matrix(batch.column(1)), w) + 0.0).view(np.uint64)  # no negative zero
                bits = np.where(bits & sign, ~bits, bits | sign) >> np.uint64(shift)
                for h, own in counts.items():
                    own += np.bincount((bits[bits >> np.uint64(16) == h] & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            for h, own in counts.items():
                digits = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(digits), h, np.int64)), pa.array(digits.astype(np.int32)), pa.array(own[digits])], names=["head", "digit", "n"])

        found = rows.mapInArrow(run, "head long, digit int, n long").groupBy("head", "digit").agg(F.sum("n").alias("n")).orderBy("head", "digit").toArrow()
        head, digit, n = (found.column(c).to_numpy() for c in ("head", "digit", "n"))
        for i, h in enumerate(heads):
            own = np.flatnonzero(head == h)
            ends = n[own].cumsum()
            k = int(np.searchsorted(ends, left[i], side="right"))
            left[i] -= int(ends[k] - n[own[k]])
            heads[i] = h << 16 | int(digit[own[k]])
    bits = np.array(heads, dtype=np.uint64)
    return np.where(bits & sign, bits ^ sign, ~bits).view(np.float64).tolist()


def _fitted(scratch: Scratch, rows: DataFrame, labels: DataFrame, label: str) -> Ranking | None:
    """The model of written measures and labels: every pair of labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("k_id"), (F.col(label) > 0).cast("int").alias("label")).where((fold(F.col("doc_id")) != HELD_OUT) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = scratch.keep(known)
    ours = scratch.keep(rows.where(~F.col("held_out")).join(broadcast_if(known, _BROADCAST), F.col("doc_id") == F.col("k_id")).select("label", "x"))
    counts = {r["label"]: r["n"] for r in ours.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    ours = ours.coalesce(_TASKS)
    n = len(ours.first()["x"])
    w = _minimise(lambda w: _all_pairs_loss(_moments(ours, w), n), n)
    return Ranking(w, _cutoff(counts[0], sum(counts.values()), lambda ranks: _ranked(ours, w, ranks)))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Ranking | None:
    """Fit on all labelled rows outside the held-out fold."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(measure(docs.where(fold(F.col(doc_id)) != HELD_OUT), doc_id=doc_id, text=text), BATCH)
    model = _fitted(scratch, rows, labels, label)
    scratch.drop()
    return model


def scored(rows: DataFrame, model: Ranking | None, *, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, held_out, score, predicted) of measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(2))) if model and batch.num_rows else np.full(batch.num_rows, cutoff)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= cutoff).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def score(docs: DataFrame, model: Ranking | None, *, doc_id: str = "doc_id", text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    return scored(measure(docs, doc_id=doc_id, text=text), model, cutoff=cutoff)


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    scratch = Scratch(spark)
    rows = scratch.keep(measure(docs), BATCH)
    model = _fitted(scratch, rows, labels, "quality")
    scratch.only(rows)
    return scored(rows, model)
