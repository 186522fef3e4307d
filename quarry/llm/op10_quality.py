"""Document quality by a factorisation machine.

Features of a document are its distinct words, hashed to 2^BITS buckets and scaled
to unit length, statistics of its text's structure and size, and metadata: the
length its table states (``n_chars``), and whether it states any. The machine adds a
bias, a weight for each feature and, for each pair of features, the product of their
factor vectors; the sum over all pairs is taken in linear time as half of
(sum v x)^2 - sum (v x)^2, for each factor. It is fitted by AdaGrad on the
logistic loss, in numpy.

It learns from at most TRAIN_ROWS labelled documents of at most TRAIN_CHARS
characters (both are parameters), those with the smallest hashes of doc_id; all
texts are scored whole, and each by itself: a score doesn't depend on what it is
scored with.

Edge cases: a text that is null or has no word is scored from its structure
alone; a length that is missing, negative or no number counts as not stated; a label
that is null isn't learned from; of several labels of an id the largest counts, of
several texts the one with the smallest hash; with no training row, or only one
class, every score is the share of label 1 (0.5 if there is none); repeated rows get
equal rows; a text of any length is one row of features; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import find_words, hash_words, held_out, prepare, row_of, schema_of, slices, smallest_hashes, table, unused

BITS, FACTORS, UPDATES, RATE, DECAY = 15, 8, 300, 0.1, 1e-5
TRAIN_ROWS, TRAIN_CHARS = 6000, 20_000
THRESHOLD = 0.3
_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!?", "*#%&$", "|", ".,;:", "\n", "@+=\"'<>{}[]()/\\_~^`-")
STATS = len(_GROUPS) + 12
_KIND = np.full(256, len(_GROUPS), np.int64)
for _i, _chars in enumerate(_GROUPS):
    _KIND[[ord(c) for c in _chars]] = _i


def features(data: np.ndarray, offsets: np.ndarray, stated: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of distinct words (row by row), their row bounds, and the statistics and metadata of each row.

    ``stated``: the length that the table states for each row; NaN where it states none.
    """
    n = len(offsets) - 1
    stated = np.full(n, np.nan) if stated is None else stated
    known = stated >= 0
    starts, ends, firsts = find_words(data, offsets)
    words = hash_words(data, starts, ends)
    row = row_of(firsts)
    size, count = np.diff(offsets).astype(np.float64), np.diff(firsts).astype(np.float64)
    cell = np.unique(row << BITS | (words >> np.uint64(64 - BITS)).astype(np.int64))
    bounds = np.searchsorted(cell, np.arange(n + 1) << BITS)
    per = lambda x: np.bincount(row, x, n) / np.maximum(count, 1)
    kinds = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * (len(_GROUPS) + 1) + _KIND[data], minlength=n * (len(_GROUPS) + 1)).reshape(n, -1)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((words, row))
    w, r = words[order], row[order]
    same = np.zeros(len(w), bool)
    same[1:] = (w[1:] == w[:-1]) & (r[1:] == r[:-1])
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    length = (ends - starts).astype(np.float64)
    upper = np.zeros(len(words))
    if len(words):
        upper = ((data[starts] >= 65) & (data[starts] <= 90)).astype(np.float64)
    odd = ~np.isin(last, np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,0123456789", np.uint8)) & (last < 128)
    stats = np.column_stack([
        np.sqrt(kinds / np.maximum(size, 1)[:, None])[:, : len(_GROUPS)],
        per(again), np.bincount(r, same, n) / np.maximum(count, 1), per(length) / 10.0, per(upper), per(odd),
        np.log1p(count) / 10.0, np.log1p(size) / 12.0, count < 5, count < 20, np.ones(n),
        np.log1p(np.where(known, stated, 0)) / 12.0, known,
    ])
    return cell & ((1 << BITS) - 1), bounds, stats.astype(np.float32)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``values`` between bounds, each by itself."""
    total = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64)
    some = np.diff(bounds) > 0
    if some.any():
        total[some] = np.add.reduceat(values.astype(np.float64), bounds[:-1][some], axis=0)
    return total


def _times(stats: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The matrix product, row by row: that of a library depends in its last digits on the rows beside."""
    return (stats.astype(np.float64)[:, :, None] * weights).sum(axis=1)


@dataclass
class QualityModel:
    bias: float
    weights: np.ndarray  # buckets, then statistics
    factors: np.ndarray
    constant: float | None = None

    def raw(self, cell: np.ndarray, bounds: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scale = 1.0 / np.sqrt(np.maximum(np.diff(bounds), 1))
        x = np.repeat(scale, np.diff(bounds)).astype(np.float32)
        words = 1 << BITS
        linear = self.bias + _sums(self.weights[cell] * x, bounds) + _times(stats, self.weights[words:, None])[:, 0]
        vx = self.factors[cell] * x[:, None]
        v = self.factors[words:]
        total = _sums(vx, bounds) + _times(stats, v)
        squares = _sums(vx * vx, bounds) + _times(stats * stats, v * v)
        return linear + 0.5 * (total * total - squares).sum(axis=1), x, total

    def score(self, data: np.ndarray, offsets: np.ndarray, stated: np.ndarray | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        z = self.raw(*features(data, offsets, stated))[0]
        return np.round(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))), 9)


def fit(texts: list[str], labels: list[int], stated: list[float | None] | None = None, seed: int = 5) -> QualityModel:
    y = np.array(labels, np.float64)
    words = 1 << BITS
    rng = np.random.default_rng(seed)
    model = QualityModel(0.0, np.zeros(words + STATS, np.float32), rng.normal(0, 0.05, (words + STATS, FACTORS)).astype(np.float32))
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    cell, bounds, stats = features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), None if stated is None else np.array(stated, np.float64))
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    seen_w, seen_v, seen_b = np.full(len(model.weights), 1e-3), np.full(model.factors.shape, 1e-3), 1e-3
    for _ in range(-(-UPDATES // -(-len(y) // 128))):  # as many updates for few rows as for many
        order = rng.permutation(len(y))
        for k in range(0, len(y), 128):
            rows = order[k : k + 128]
            size = np.diff(bounds)[rows]
            own_bounds = np.concatenate(([0], np.cumsum(size)))
            own = cell[np.repeat(bounds[rows] - own_bounds[:-1], size) + np.arange(own_bounds[-1])]
            s = stats[rows]
            z, x, total = model.raw(own, own_bounds, s)
            error = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            at = np.repeat(np.arange(len(rows)), size)
            gw = np.bincount(own, error[at] * x, len(model.weights))
            gw[words:] = error @ s
            hit = np.unique(own)
            place = np.searchsorted(hit, own)
            pull = (error[at] * x)[:, None] * (total[at] - model.factors[own] * x[:, None])
            gv = np.column_stack([np.bincount(place, pull[:, f], len(hit)) for f in range(FACTORS)]) if len(hit) else np.zeros((0, FACTORS))
            gs = (s * error[:, None]).T @ total - model.factors[words:] * ((s * s) * error[:, None]).sum(axis=0)[:, None]
            index = np.concatenate([hit, np.arange(words, words + STATS)])
            gv = np.concatenate([gv, gs]) + DECAY * model.factors[index]
            gw_ = gw[index] + DECAY * model.weights[index]
            seen_w[index] += gw_ * gw_
            seen_v[index] += gv * gv
            model.weights[index] -= (RATE * gw_ / np.sqrt(seen_w[index])).astype(np.float32)
            model.factors[index] -= (0.3 * RATE * gv / np.sqrt(seen_v[index])).astype(np.float32)
            gb = error.sum()
            seen_b += gb * gb
            model.bias -= RATE * gb / np.sqrt(seen_b)
    return model


def _stated(docs: DataFrame, length: str) -> Column:
    """The length a table states, as a double; null where it has no such column or it holds no number."""
    return F.expr(f"try_cast(`{length}` AS double)") if length in docs.columns else F.lit(None).cast("double")


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_chars: int = TRAIN_CHARS, length: str = "n_chars") -> DataFrame:
    """The bounded sample: ids are chosen among labels, then their texts are read."""
    able = labels.filter(F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").alias("label"), F.xxhash64("doc_id").alias("turn"))
    chosen = smallest_hashes(able, "turn", rows).groupBy("doc_id", "turn").agg(F.max("label").alias("label")).orderBy(F.pmod("turn", F.lit(1 << 40)), "doc_id").limit(rows).drop("turn")
    own = docs.select("doc_id", "text", _stated(docs, length).alias("stated")).filter(F.length("text") <= max_chars)
    near = own.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows of two numbers are broadcast
    return near.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("turn"), "text", "stated")).alias("d"), F.first("label").alias("label")).select("doc_id", "d.text", "d.stated", "label")


def train(docs: DataFrame, labels: DataFrame, length: str = "n_chars") -> QualityModel:
    rows = sorted(training_rows(docs, labels, length=length).collect(), key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], [r["label"] for r in rows], [np.nan if r["stated"] is None else r["stated"] for r in rows])


def score(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text", length: str = "n_chars") -> DataFrame:
    """The kept columns and score (0 to 1)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: 2^BITS x (FACTORS + 1) numbers
    out = unused("score", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, name):
                values = shared.value.score(data, offsets, part.column(stated).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(values, pa.float64())], names=[*keep, out])

    name = unused("text", keep)
    stated = unused("stated", [*keep, name])
    rows = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").alias(name), _stated(docs, length).alias(stated))
    return rows.mapInArrow(run, schema_of(docs, keep, f"`{out}` double"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
