"""Centroid clustering with exact results: screening in float32, rounding-error intervals, whole numbers where they overlap.

Each component x becomes the whole number floor(64 x). The first centroids are the
vectors whose ids hash lowest. A round assigns every vector to its nearest centroid
and replaces each centroid by the floor of its vectors' mean.

|x - c|^2 is ordered like |c|^2 - 2 x.c. The products x.c of a batch are one float32
matrix product. However they are summed, each is within g |x| |c| of the true one,
where g bounds the rounding of both conversions and of the sum (`_GAMMA`). So every
distance lies in an interval, and a centroid whose interval begins beyond the end of
another's can't be nearest. Where more than one is left, the distances are computed in whole
numbers, and equal ones go to the smaller centroid number. The result doesn't depend
on batches, tasks or the order of sums.

Sums of a cluster are whole numbers of any size: tasks send their partial sums in
digits of 40 bits, which Spark adds up. Centroids (k times the dimension) are all that the
driver holds.

Edge cases: vectors that are null, of another length, or hold null or non-finite
components take no part; one without id is clustered, but starts no centroid; of
vectors that share an id, the one with the smallest components comes first; fewer
vectors than centroids give fewer centroids; an empty centroid stays; distances and
inertias that no long holds count as the largest long; an empty table gives an empty
table; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import cut, drop, prepare

K, ROUNDS, DIMENSION, SCALE = 16, 3, 64, 64
MOST = (1 << 63) - 1
#: Components below this make differences, squares and their sums that a long holds, for up to 2^8 components.
SMALL = 1 << 26
#: Bits of a digit of the sums: 2^22 tasks' digits add up within a long.
DIGIT = 40


def _kept(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    """`vec_id, v` of the vectors that take part: floor(64 x) / 64 as doubles, which hold it for every finite x."""
    for b in batches:
        v = b["embedding"]
        off = v.offsets.to_numpy()
        size = np.diff(off)
        x = v.values.slice(off[0], off[-1] - off[0]).cast(pa.float64()).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(v)), size)
        good = v.is_valid().to_numpy(zero_copy_only=False) & (size == dimension)
        good[row[~np.isfinite(x)]] = False
        x = x[good[row]]
        fine = np.abs(x) < 2.0**45  # from there on, 64 x is whole
        x = np.where(fine, np.floor(SCALE * np.where(fine, x, 0)) / SCALE, x)
        ends = np.arange(good.sum() + 1, dtype=np.int32) * dimension
        yield pa.RecordBatch.from_arrays([b["vec_id"].cast(pa.int64()).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], names=["vec_id", "v"])


def matrix(v: pa.Array, dimension: int) -> np.ndarray:
    off = v.offsets.to_numpy()
    return v.values.to_numpy()[off[0] : off[-1]].reshape(-1, dimension)


def whole(x: np.ndarray) -> list[int]:
    """The components floor(64 x) of one row as Python's integers."""
    return [int(v * SCALE) if abs(v) < 2.0**900 else int(v) * SCALE for v in x.tolist()]


def _gamma(terms: int) -> float:
    """Bound of the relative error of a float32 sum of so many products, both factors rounded to float32 before."""
    u = (terms + 3) * 2.0**-24
    return u / (1 - u)


class Centroids:
    """Centroids as whole numbers, and what screening against them needs."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.small = all(abs(c) < SMALL for r in rows for c in r)
        self.wide = any(abs(c) > 1 << 900 for r in rows for c in r)
        self.exact = np.array(rows, np.int64) if self.small else None
        near = np.zeros((len(rows), len(rows[0]))) if self.wide else np.array([[c / SCALE for c in r] for r in rows])
        with np.errstate(over="ignore"):
            self.single = near.astype(np.float32)
            self.square = (near * near).sum(1)

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of |c|^2 - 2 x.c for each row of x and each centroid; unbounded where floats overflow."""
        with np.errstate(over="ignore", invalid="ignore"):
            product = (x.astype(np.float32) @ self.single.T).astype(float)
            lengths = np.sqrt((x * x).sum(1))[:, None] * np.sqrt(self.square)
            middle = self.square - 2 * product
            # the second summand covers the double precision of this arithmetic itself
            error = 2.001 * _gamma(x.shape[1]) * lengths + 1e-12 * (self.square + lengths)
            low, high = middle - error, middle + error
        lost = ~(np.isfinite(low) & np.isfinite(high)).all(1) | self.wide
        low[lost], high[lost] = -np.inf, np.inf
        return low, high

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """The nearest centroid of each row, and how many rows whole numbers decided."""
        low, high = self.intervals(x)
        open_ = low <= high.min(1)[:, None]
        out = open_.argmax(1)
        unsure = np.flatnonzero(open_.sum(1) > 1)
        if len(unsure):
            out[unsure] = self._decide(x[unsure], open_[unsure])
        return out, len(unsure)

    def _decide(self, x: np.ndarray, open_: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        fits = np.abs(x).max(1) < SMALL // SCALE if self.small else np.zeros(len(x), bool)
        w = (SCALE * x[fits]).astype(np.int64)
        best = np.full(len(w), MOST)
        place = np.zeros(len(w), np.int64)
        for k in range(len(self.rows)):
            d = w - self.exact[k] if self.small else w
            d = np.where(open_[fits, k], (d * d).sum(1), MOST)
            nearer = d < best  # equal distances stay with the smaller number
            best[nearer], place[nearer] = d[nearer], k
        out[fits] = place
        for i in np.flatnonzero(~fits).tolist():
            v = whole(x[i])
            out[i] = min((sum((a - b) ** 2 for a, b in zip(v, self.rows[k], strict=True)), k) for k in np.flatnonzero(open_[i]).tolist())[1]
        return out

    def distances(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Exact squared distances, at most the largest long."""
        out = np.zeros(len(x), np.int64)
        fits = np.abs(x).max(1, initial=0) < SMALL // SCALE if self.small else np.zeros(len(x), bool)
        if fits.any():
            d = (SCALE * x[fits]).astype(np.int64) - self.exact[to[fits]]
            out[fits] = (d * d).sum(1)
        for i in np.flatnonzero(~fits).tolist():
            out[i] = min(MOST, sum((a - b) ** 2 for a, b in zip(whole(x[i]), self.rows[to[i]], strict=True)))
        return out


def _digits(total: int, n: int) -> list[int]:
    """n digits of DIGIT bits, the last one with the sign."""
    return [total >> DIGIT * j & (1 << DIGIT) - 1 for j in range(n - 1)] + [total >> DIGIT * (n - 1)]


def means(vectors: DataFrame, now: Centroids, dimension: int) -> list[list[int]]:
    """The centroids after one round over `v`."""
    held = vectors.sparkSession.sparkContext.broadcast(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        k = len(c.rows)
        sums, count = [[0] * dimension for _ in range(k)], np.zeros(k, np.int64)
        for b in batches:
            x = matrix(b["v"], dimension)
            to, _ = c.assign(x)
            count += np.bincount(to, minlength=k)
            fits = np.abs(x).max(1, initial=0) < 2.0**33
            w, at = (SCALE * x[fits]).astype(np.int64), to[fits]
            for j in np.unique(at).tolist():
                sums[j] = [a + s for a, s in zip(sums[j], w[at == j].sum(0).tolist(), strict=True)]
            for i in np.flatnonzero(~fits).tolist():
                sums[to[i]] = [a + s for a, s in zip(sums[to[i]], whole(x[i]), strict=True)]
        rows = []
        for j in np.flatnonzero(count).tolist():
            n = max(s.bit_length() for s in sums[j]) // DIGIT + 1
            parts = [_digits(s, n) for s in sums[j]]
            rows += [(j, d, int(count[j]) if d == 0 else 0, [p[d] for p in parts]) for d in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["cluster", "digit", "n", "s"])

    parts = vectors.select("v").mapInArrow(run, "cluster long, digit long, n long, s array<long>")
    got = parts.groupBy("cluster", "digit").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dimension))).collect()
    held.unpersist()
    out = [list(r) for r in now.rows]
    sums: dict[int, list[int]] = {}
    for r in got:
        sums[r.cluster] = [a + (r[f"s{i}"] << DIGIT * r.digit) for i, a in enumerate(sums.get(r.cluster, [0] * dimension))]
    for j, s in sums.items():
        n = sum(r.n for r in got if r.cluster == j)
        out[j] = [a // n for a in s]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION) -> DataFrame:
    """`vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256` of every vector that takes part."""
    spark = prepare(vectors.sparkSession)
    kept = cut(vectors.select("vec_id", "embedding").mapInArrow(lambda batches: _kept(batches, dimension), "vec_id long, v array<double>"))
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    # k rows, however many vectors there are
    first = kept.where("vec_id IS NOT NULL").orderBy(order, "v").limit(k).select("v").collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        drop(kept)
        return spark.createDataFrame([], schema)
    now = Centroids([whole(np.array(r.v)) for r in first])
    for _ in range(rounds):
        now = Centroids(means(kept, now, dimension))
    held = spark.sparkContext.broadcast(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["v"], dimension)
            to, _ = held.value.assign(x)
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(to, pa.int32()), pa.array(held.value.distances(x, to))], names=["vec_id", "cluster", "distance"])

    assigned = cut(kept.mapInArrow(run, "vec_id long, cluster int, distance long"))
    drop(kept)
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = min(MOST, sum(sums.values()))
    digest = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in now.rows]
    facts = spark.createDataFrame([(j, min(MOST, s), inertia, digest[j]) for j, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION) -> str:
    step = """
a{r} AS (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(e) AS e, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT rid, vec_id, e, k, CAST(list_inner_product(e, e) - 2 * list_inner_product(e, c) + list_inner_product(c, c) AS BIGINT) AS d FROM v, c{r}) GROUP BY rid)"""
    mean = """
m{r} AS (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS m
  FROM (SELECT k, i, sum(CAST(e[i] AS BIGINT)) AS s, count(*) AS n FROM a{r}, range(1, {d}) t(i) GROUP BY k, i) GROUP BY k),
c{n} AS (SELECT c{r}.k, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.k = c{r}.k)"""
    parts = [step.format(r=r) + ("," + mean.format(r=r, n=r + 1, d=dimension + 1) if r < rounds else "") for r in range(rounds + 1)]
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS k, e AS c FROM v WHERE vec_id IS NOT NULL QUALIFY k < {k}),
{",".join(parts)},
h AS (SELECT k, sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS h FROM c{rounds})
SELECT vec_id, CAST(a{rounds}.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN h ON h.k = a{rounds}.k
"""


#: DuckDB SQL of the query.
ORACLE = _oracle()
