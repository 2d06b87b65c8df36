"""Quality classifier: a factorisation machine.

Features are hashed lower-case words (log counts, scaled to length one),
structure statistics of the text, and the metadata column n_chars. The pairwise
term, sum over i < j of <v_i, v_j> x_i x_j, is scored in linear time as half of
(sum v x)^2 - sum (v x)^2. Label, language, source and id are no features.

The model is fitted on the driver, on at most `TRAIN_ROWS` labelled rows (those
with the smallest hash of their id), a documented bound; every row is scored.

Edge cases: null text is empty text and gets a score from its statistics; null
n_chars counts as 0; a text of any length is scored whole; without labelled rows all
scores are 0.5; a repeated row gets its copy's score; of rows that share a labelled
id, the smallest text (then n_chars) is learnt from; a row without id is never
learnt from, and counts as not held out; an empty table gives an empty table; other
columns are neither read nor returned by `classify`, and stay in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import common, quality_rules
from parlance.llm.common import prepare

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 4000
BITS, RANK, EPOCHS, RATE, DECAY = 14, 8, 12, 0.08, 2e-5
STATS = ("bias", "log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "exclaims", "digits", "lines", "distinct", "log_n_chars", "short", "neighbours")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of each non-zero word feature, rows ascending; and the statistics of each row."""
    base = quality_rules.base_counts(texts).astype(float)
    stats = np.zeros((len(texts), len(STATS)))
    rows, feats, values = [], [], []
    for i, buf, off in common.slices(texts):
        n = len(off) - 1
        h, first, start, _ = common.words_of(buf, off, lower=True)
        row = np.repeat(np.arange(n), np.diff(first))
        key, count = np.unique(row << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        r, x = key >> BITS, np.log1p(count)
        norm = np.sqrt(np.bincount(r, x * x, n))
        rows.append(r + i)
        feats.append(key & (1 << BITS) - 1)
        values.append(x / norm[r])
        words = np.maximum(np.diff(first), 1)
        per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off]) / words  # noqa: E731, B023
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        to = slice(i, i + n)
        stats[to, 6] = per((buf >= 65) & (buf <= 90))
        stats[to, 7] = per(buf == 33)
        stats[to, 8] = per((buf >= 48) & (buf <= 57))
        stats[to, 9] = per(buf == 10)
        stats[to, 10] = np.bincount(r, minlength=n) / words
        stats[to, 13] = np.bincount(row[same], minlength=n) / words
    words = np.maximum(base[:, 0], 1)
    stats[:, 0] = 1
    stats[:, 1] = np.log1p(base[:, 0]) / 8
    stats[:, 2] = base[:, 1] / words / 8
    stats[:, 3] = base[:, 2] / words
    stats[:, 4] = base[:, 3] / 10
    stats[:, 5] = base[:, 4] / words
    stats[:, 11] = np.log1p(np.maximum(np.nan_to_num(n_chars), 0)) / 10
    stats[:, 12] = base[:, 0] < 10
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return cat(rows, np.int64), cat(feats, np.int64), cat(values, float), np.minimum(stats, 4)


@dataclass
class Machine:
    """w0 and w: linear weights; v: a vector of RANK factors for each feature. Statistics come after the hashed words."""

    w: np.ndarray
    v: np.ndarray

    @classmethod
    def new(cls) -> "Machine":
        size = (1 << BITS) + len(STATS)
        return cls(np.zeros(size), np.random.default_rng(7).normal(0, 0.05, (size, RANK)))

    def raw(self, row: np.ndarray, feat: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and each row's sum of v x."""
        vx = self.v[feat] * x[:, None]
        total, squares = np.zeros((n, RANK)), np.zeros(n)
        for k in range(RANK):
            total[:, k] = np.bincount(row, vx[:, k], n)
        squares += np.bincount(row, (vx * vx).sum(1), n)
        return np.bincount(row, self.w[feat] * x, n) + 0.5 * ((total * total).sum(1) - squares), total

    def score(self, row, feat, x, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(row, feat, x, n)[0], -30, 30)))


def entries(row, feat, x, stats):
    """Word features and statistics as one list of (row, feature, value), rows ascending."""
    n, k = stats.shape
    r = np.concatenate([row, np.repeat(np.arange(n), k)])
    f = np.concatenate([feat, np.tile(np.arange(k) + (1 << BITS), n)])
    v = np.concatenate([x, stats.ravel()])
    by = np.argsort(r, kind="stable")
    return r[by], f[by], v[by]


def fit(row, feat, x, y: np.ndarray) -> Machine:
    """Logistic loss by mini-batches with AdaGrad steps; the order of rows and the seed fix the result."""
    m = Machine.new()
    n, rng = len(y), np.random.default_rng(11)
    begin = np.searchsorted(row, np.arange(n + 1))
    gw, gv = np.full(len(m.w), 1e-6), np.full(m.v.shape, 1e-6)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + 0.2 * epoch)
        order = rng.permutation(n)
        for at in range(0, n, 32):
            batch = order[at : at + 32]
            take = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in batch])
            r = np.repeat(np.arange(len(batch)), begin[batch + 1] - begin[batch])
            f, v = feat[take], x[take]
            raw, total = m.raw(r, f, v, len(batch))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[batch]) / len(batch)
            used, back = np.unique(f, return_inverse=True)
            step = error[r] * v
            dw = np.bincount(back, step, len(used)) + DECAY * m.w[used]
            gw[used] += dw * dw
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            for k in range(RANK):
                dv = np.bincount(back, step * (total[r, k] - m.v[f, k] * v), len(used)) + DECAY * m.v[used, k]
                gv[used, k] += dv * dv
                m.v[used, k] -= rate * dv / np.sqrt(gv[used, k])
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on `labels` (doc_id, quality) outside the held-out third; of a document labelled twice, the smaller label counts."""
    some = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 100):
                part = b.slice(i, 100)
                r, f, x = entries(*features(part["text"], part["n_chars"].cast(pa.float64()).to_numpy(zero_copy_only=False)))
                cut = np.searchsorted(r, np.arange(len(part)))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].cast(pa.int64()), part["quality"].cast(pa.int32()), pa.array([a.tobytes() for a in np.split(f.astype(np.int32), cut[1:])], pa.binary()), pa.array([a.tobytes() for a in np.split(x.astype(np.float32), cut[1:])], pa.binary())],
                    names=["doc_id", "quality", "f", "x"],
                )

    # at most `rows` small rows are broadcast; of the texts, one for each of their ids is shuffled, copies meet before
    own = docs.select("doc_id", "text", "n_chars").join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("x"))
    got = own.select("doc_id", "quality", "x.text", "x.n_chars").mapInArrow(run, "doc_id long, quality int, f binary, x binary").toPandas()
    got = got.sort_values("doc_id")
    if got.empty:
        return Machine(np.zeros((1 << BITS) + len(STATS)), np.zeros(((1 << BITS) + len(STATS), RANK)))
    f = [np.frombuffer(a, np.int32) for a in got.f]
    x = np.concatenate([np.frombuffer(a, np.float32) for a in got.x]).astype(float)
    return fit(np.repeat(np.arange(len(f)), [len(a) for a in f]), np.concatenate(f).astype(np.int64), x, (got.quality.to_numpy() == 1).astype(float))


def _scores(model: Machine, batch: pa.RecordBatch) -> np.ndarray:
    score = []
    for i in range(0, len(batch), 500):
        part = batch.slice(i, 500)
        score.append(model.score(*entries(*features(part["text"], part["n_chars"].cast(pa.float64()).to_numpy(zero_copy_only=False))), len(part)))
    return np.concatenate(score) if score else np.zeros(0)


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every document."""
    model = prepare(docs.sparkSession).sparkContext.broadcast(train(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scores(model.value, b)
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text", "n_chars").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents, all columns as they are, whose score is at least `least`."""
    model = prepare(docs.sparkSession).sparkContext.broadcast(train(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(model.value, b) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
