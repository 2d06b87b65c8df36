"""Exact top-k inner-product search.

Vectors are dealt and sorted by descending length. Each task walks its blocks in
that order with the k-th best score that every query has so far. A block is left
out for a query if |query| * |longest vector of the block| is below it; inside a
block, the product over the first coordinates of an SVD rotation plus the
Cauchy-Schwarz bound of both residuals prunes vectors, and only those that are
left get the exact integer product. Queries start with the k-th best score among
the `SEED` longest vectors, so that even the first block is pruned.

Queries are held by the executors in chunks of about `CHUNK`, fewer where `CHUNK_BYTES` of long vectors are; the chunks' results
are written one after another, so that no more than a chunk is ever
broadcast.

Products are exact for every finite vector. Where the product of two lengths is
below 2^52, every partial sum is a whole number that a double holds; below 2^62,
one that a long holds; beyond that, Python's integers are used. A score that no
long holds counts as the nearest long.

Edge cases: vectors that are null, or hold null or non-finite components, take no
part, nor do rows without id; shorter vectors count as ending in zeros; equal
scores go to the smaller id; fewer than k candidates are all returned. Rows that
share an id: each is a candidate by itself (so that an id can take several
ranks), none is one for its own id, and an id asks once, with the vector that
comes first in the order of its components. An empty table gives an empty table;
other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import cut, drop, prepare

K, EVERY, SCALE = 5, 50, 256.0
#: Longest vectors that the first bounds come from, and queries held at a time, in number and bytes.
SEED, CHUNK, CHUNK_BYTES = 1024, 1 << 14, 64 << 20
BLOCK = 512
#: Share of the coordinates in the partial sum.
PART = 0.25
#: Products of lengths up to which doubles and longs are exact.
DOUBLES, LONGS = 2.0**52, 2.0**62
MOST = (1 << 63) - 1


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as doubles floor(256 x) / 256, which hold every finite x, and their lengths before the division."""
    for b in batches:
        v = b["embedding"]
        off, row = v.offsets.to_numpy(), np.repeat(np.arange(len(v)), np.diff(v.offsets.to_numpy()))
        x = v.values.slice(off[0], off[-1] - off[0]).cast(pa.float64()).to_numpy(zero_copy_only=False)
        good = b["vec_id"].is_valid().to_numpy(zero_copy_only=False) & v.is_valid().to_numpy(zero_copy_only=False)
        good[row[~np.isfinite(x)]] = False
        # from 2^45 on, 256 x is a whole number
        small = np.abs(x) < 2.0**45
        x = np.where(small, np.floor(SCALE * np.where(small, x, 0)) / SCALE, x)
        with np.errstate(over="ignore", invalid="ignore"):
            length = SCALE * np.sqrt(np.bincount(row, x * x, len(v)))
        steps = pa.ListArray.from_arrays(pa.array((off - off[0]).astype(np.int32)), pa.array(x))
        out = pa.RecordBatch.from_arrays([b["vec_id"].cast(pa.int64()), pa.array(length), steps], names=["vec_id", "length", "v"])
        yield out.filter(pa.array(good))


def matrix(v: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """The vectors as rows of d doubles, zeros behind the shorter ones."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    off = v.offsets.to_numpy()
    flat, size = v.values.to_numpy()[off[0] : off[-1]], np.diff(off)
    if (size == d).all():
        return flat.reshape(len(v), d)
    out = np.zeros((len(v), d))
    out[np.repeat(np.arange(len(v)), size), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
    return out


def whole(x: np.ndarray) -> list[int]:
    """The components of one vector as Python's integers."""
    return [int(v * SCALE) if abs(v) < 2.0**900 else int(v) * int(SCALE) for v in x.tolist()]


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of all rows, the largest first: eigenvectors of the summed d x d products.

    Rows longer than 2^30 count as of that length, so that the sums stay finite; any rotation gives right bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = matrix(b["v"], d)
            most = np.maximum(np.abs(x).max(1, initial=0), 1)[:, None]
            x = x / most * np.minimum(most, 2.0**30)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["at", "s"])

    got = vectors.select("v").mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toPandas()
    gram = np.zeros(d * d)
    gram[got["at"].to_numpy()] = got["s"].to_numpy()
    values, basis = np.linalg.eigh(gram.reshape(d, d))
    return basis[:, ::-1]


class Search:
    """The best k so far of a chunk of queries, and the bounds that prune the rest."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, basis: np.ndarray, k: int):
        self.ids, self.x, self.basis, self.k = ids, x, basis, k
        self.r = max(1, int(len(basis) * PART))
        self.y, self.length, self.rest = self.rotated(x)
        self.best = np.zeros((0, 3), np.int64)  # query, score, vector
        #: the k-th best score so far; none at all is below every score
        self.floor = np.full(len(ids), -np.inf)

    def rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First rotated coordinates, lengths and residual lengths, all before the division; beyond doubles, an unbounded residual."""
        with np.errstate(over="ignore", invalid="ignore"):
            y = SCALE * (x @ self.basis[:, : self.r])
            square = SCALE * SCALE * (x * x).sum(1)
            rest = np.sqrt(np.maximum(square - (y * y).sum(1), 0))
        wide = ~(square < 2.0**1000)
        if wide.any():
            y[wide], square[wide], rest[wide] = 0, np.inf, np.inf
        return y, np.sqrt(square), rest

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids):
            return
        y, length, rest = self.rotated(x)
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-6 * (1 + self.length * length.max())
            q = np.flatnonzero(~(self.length * length.max() + slack < self.floor))
            if not len(q):
                return
            bound = self.y[q] @ y.T + self.rest[q][:, None] * rest + slack[q][:, None]
        a, b = np.nonzero(~(bound < self.floor[q][:, None]))
        dense = len(a) * 4 > len(q) * len(ids)
        row = a
        a = q[a]
        other = self.ids[a] != ids[b]
        a, b, row = a[other], b[other], row[other]
        score = self.products(x, q, a, b, row, length, dense)
        new = np.stack([a, score, ids[b]], 1)
        new = new[~(score < self.floor[a])]
        every = np.concatenate([self.best, new])
        # ~score instead of -score: the smallest long has no opposite
        every = every[np.lexsort((every[:, 2], ~every[:, 1], every[:, 0]))]
        first = np.searchsorted(every[:, 0], every[:, 0])
        place = np.arange(len(every)) - first
        self.best = every[place < self.k]
        last = every[place == self.k - 1]
        # a double below the score, as a long may lie between two doubles
        self.floor[last[:, 0]] = np.maximum(self.floor[last[:, 0]], np.nextafter(last[:, 1].astype(float), -np.inf))

    def products(self, x: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, row: np.ndarray, length: np.ndarray, dense: bool) -> np.ndarray:
        """The exact scores of the pairs (a, b) as longs."""
        out = np.zeros(len(a), np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            size = self.length[a] * length[b]
        plain = size < DOUBLES
        if dense and plain.all():
            return np.rint(SCALE * SCALE * (self.x[q] @ x.T)[row, b]).astype(np.int64)
        for at in _parts(np.flatnonzero(plain)):
            out[at] = np.rint(SCALE * SCALE * np.einsum("ij,ij->i", self.x[a[at]], x[b[at]])).astype(np.int64)
        # whole numbers: a vector that isn't zero has a length of 1 at least, so that each length is below as well
        long = ~plain & (size < LONGS)
        for at in _parts(np.flatnonzero(long)):
            out[at] = np.einsum("ij,ij->i", (SCALE * self.x[a[at]]).astype(np.int64), (SCALE * x[b[at]]).astype(np.int64))
        wide = np.flatnonzero(~plain & ~long)
        asked = {i: whole(self.x[i]) for i in np.unique(a[wide]).tolist()}
        found = {j: whole(x[j]) for j in np.unique(b[wide]).tolist()}
        for at, i, j in zip(wide.tolist(), a[wide].tolist(), b[wide].tolist(), strict=True):
            out[at] = max(-MOST - 1, min(MOST, sum(map(int.__mul__, asked[i], found[j]))))
        return out


def _parts(at: np.ndarray, most: int = 65536) -> Iterator[np.ndarray]:
    return (at[i : i + most] for i in range(0, len(at), most))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """`query_id, rank, vec_id, score` for the queries, the ids divisible by `every`."""
    spark = prepare(vectors.sparkSession)
    steps = cut(vectors.select("vec_id", "embedding").mapInArrow(_steps, "vec_id long, length double, v array<double>"))
    d = steps.agg(F.max(F.size("v"))).first()[0]
    empty = "query_id long, score long, vec_id long"
    if d is None:
        drop(steps)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # empty vectors alone have scores of 0, as if they held a zero
    d = max(d, 1)
    # the row's number deals vectors of one length, and rows of one id, to several tasks
    by_length = steps.repartitionByRange(F.col("length").desc(), F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(F.col("length").desc(), "vec_id")
    by_length = cut(by_length)
    basis = rotation(steps, d)
    seed = steps.orderBy(F.col("length").desc(), "vec_id").limit(SEED).toArrow()
    seed_ids, seed_x = seed["vec_id"].to_numpy(), matrix(seed["v"], d)
    # an id asks once; copies meet before the shuffle
    asked = cut(steps.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    at_once = max(1, min(CHUNK, CHUNK_BYTES // (8 * d)))
    chunks = max(1, -(-asked.count() // at_once))
    parts = []
    for c in range(chunks):
        q = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).select("vec_id", "v").toArrow()
        first = Search(q["vec_id"].to_numpy(), matrix(q["v"], d), basis, k)
        for i in range(0, len(seed_ids), BLOCK // 4):
            first.add(seed_ids[i : i + BLOCK // 4], seed_x[i : i + BLOCK // 4])
        # scores of the seed only bound: the vectors themselves come again with the rest
        held = spark.sparkContext.broadcast((first.ids, first.x, basis, first.floor))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, x, basis, floor = held.value
            s = Search(ids, x, basis, k)
            s.floor = floor.copy()
            for b in batches:
                for i in range(0, len(b), BLOCK):
                    part = b.slice(i, BLOCK)
                    s.add(part["vec_id"].to_numpy(), matrix(part["v"], d))
            yield pa.RecordBatch.from_arrays([pa.array(ids[s.best[:, 0]], pa.int64()), pa.array(s.best[:, 1]), pa.array(s.best[:, 2])], names=["query_id", "score", "vec_id"])

        parts.append(cut(by_length.select("vec_id", "v").mapInArrow(run, empty)))
        held.unpersist()
    drop(steps, by_length, asked)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL of the query: the whole table against every 50th id, which asks once.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
