"""Packing by cutting-stock column generation.

Documents become token ids and are cut into pieces of `SIZE` tokens and one
shorter rest. Rests are counted by length class: each length up to `FINE` is a class
of its own, and longer ones are rounded up by less than a thirty-second part (`class_of`). The histogram, of
bounded size, goes to the driver. There a linear program over packing patterns is
solved by column generation: the master's dual prices give each class a value, and a
knapsack by dynamic programming finds the patterns that the master lacks most. The rounded
patterns, and first-fit patterns for what rounding leaves, are numbered sequences with slots for
each class. Rests are ranked within their class from their task's counts, and the
rank names the slot. Offsets follow from the true lengths, so sequences have no
gaps; what a sequence lacks to `SIZE` is padding at its end. Full pieces are sequences by
themselves.

Edge cases: null or empty text is the end id alone; a document of any length is
cut; equal lengths, repeated rows and rows without id get different slots; an empty
table gives an empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import cut, prepare

SIZE, END = 4096, 2
CAPACITY = SIZE
#: Lengths up to which each is a class; from there on, each doubling has so many classes at most.
FINE, CLASSES = 64, 64
#: Patterns that one pricing finds at most, and patterns that are kept for later prices.
FOUND, POOL = 24, 600
#: Words that are known at most, and that stay known after a task, as a worker lives on.
CACHE_WORDS, LASTING_WORDS = 600_000, 100_000
#: Words of plain Latin letters that are tokenised as one text.
JOINED = 200
#: A lower-cased word of plain Latin letters, and sentence marks behind it: two tokens for the pre-tokeniser in any case.
_PLAIN = re.compile("^(?:([a-zß-öø-ÿ]+)([.,;:!?]*)|(.+))$", re.M)


class _Numbers(dict):
    """Numbers words as they are first looked up."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordTokens:
    """Ids of whole texts by the ids of their words: this tokenizer's normaliser and pre-tokeniser never look over ASCII white space.

    Words of plain Latin letters need neither of them but for the lower case, so
    that many go through the merges as one text; the end-of-word suffix says where
    each ends. Any other word goes through the whole tokenizer. What is known is
    kept up to `CACHE_WORDS` words; this saves time and changes no result.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number, self.data = _Numbers(), []

    def _learn(self, words: list[bytes]) -> None:
        whole = [w.decode(errors="replace") for w in words]
        found = _PLAIN.findall("\n".join(whole).lower())
        base = len(self.data)
        self.data += [b""] * len(words)
        plain = [i for i, (a, _, _) in enumerate(found) if a]
        chunks = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        texts = [" ".join([f"{a} {b}" if b else a for a, b, _ in map(found.__getitem__, chunk)]) for chunk in chunks]
        for chunk, e in zip(chunks, self.merges.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            data = ids.tobytes()
            last = np.cumsum([2 if found[i][1] else 1 for i in chunk]) - 1
            to = ((np.flatnonzero(self.ends[ids])[last] + 1) * 4).tolist()
            for i, x, y in zip(chunk, [0, *to], to, strict=False):
                self.data[base + i] = data[x:y]
        other = [i for i, (a, _, _) in enumerate(found) if not a]
        for i, e in zip(other, self.tokenizer.encode_batch_fast([whole[i] for i in other], add_special_tokens=False), strict=True):
            self.data[base + i] = np.array(e.ids, "<u4").tobytes()

    def encode_batch(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text (UTF-8) as little-endian unsigned 32-bit numbers."""
        if len(self.data) > CACHE_WORDS:
            self.clear()
        number = self.number
        rows = [list(map(number.__getitem__, t.split())) if t else [] for t in texts]
        if number.new:
            self._learn(number.new)
            number.new = []
        return [b"".join(map(self.data.__getitem__, r)) for r in rows]


_TOKENIZERS: dict[str, WordTokens] = {}


def class_of(length: int) -> int:
    """The length rounded up to its class, which is named by its largest length."""
    if length <= FINE:
        return length
    step = max(1, 1 << (length - 1).bit_length() - 1 >> CLASSES.bit_length() - 1)
    return min(SIZE, -(-length // step) * step)


def pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of each `doc_id, text`, with their class (SIZE for full ones) and their place among the task's pieces of the class."""
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _TOKENIZERS.get(tokenizer) or _TOKENIZERS.setdefault(tokenizer, WordTokens(tokenizer))
        part, counts = TaskContext.get().partitionId(), defaultdict(int)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "part", "place"]
        for b in batches:
            for i in range(0, len(b), 256):
                rows = []
                for doc, ids in zip(b["doc_id"][i : i + 256].to_pylist(), t.encode_batch(b["text"][i : i + 256].cast(pa.binary()).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, SIZE):
                        size = min(SIZE, n - at)
                        kind = class_of(size)
                        rows.append((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n, kind, part, counts[kind]))
                        counts[kind] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)
        if len(t.data) > LASTING_WORDS:
            t.clear()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind long, part long, place long")


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int, most: int = 1) -> tuple[float, list[np.ndarray]]:
    """The most valuable multiset of items within the capacity, by dynamic programming: its value, and how often each item is in it.

    With `most`, also the best ones that hold some item, for up to that many multisets in all, the most valuable first.
    """
    m = len(size)
    # best[k]: the value of each capacity with the first k items; any number of an item at once, by running maxima in steps of its size
    best = np.zeros((m + 1, capacity + 1))
    for k in range(m):
        s, v = int(size[k]), float(value[k])
        rows = -(-(capacity + 1) // s)
        chain = np.full(rows * s, -np.inf)
        chain[: capacity + 1] = best[k]
        worth = np.arange(rows)[:, None] * v
        best[k + 1] = (np.maximum.accumulate(chain.reshape(rows, s) - worth, axis=0) + worth).ravel()[: capacity + 1]

    def taken(c: int) -> np.ndarray:
        out = np.zeros(m, np.int64)
        for k in range(m - 1, -1, -1):
            if best[k + 1, c] > best[k, c] + 1e-12:
                n = np.arange(c // int(size[k]) + 1)
                out[k] = int((best[k, c - n * int(size[k])] + n * value[k]).argmax())
                c -= int(out[k] * size[k])
        return out

    total = float(best[m, capacity])
    found = [taken(capacity)]
    if most > 1:
        with_ = value + best[m, capacity - size]
        for k in np.argsort(-with_)[: most - 1].tolist():
            if not any(p[k] for p in found):
                p = taken(capacity - int(size[k]))
                p[k] += 1
                found.append(p)
    return total, found


def greedy(size: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A basis to begin with, and how often each of its patterns is used: longest first, each pattern until one of its classes is used up.

    A pattern has no class that an earlier one used up, so that the patterns are independent.
    """
    m = len(size)
    left, basis, x = demand.astype(float), np.zeros((m, m)), np.zeros(m)
    open_ = np.ones(m, bool)
    for t in range(m):
        room, pattern = capacity, np.zeros(m)
        for k in np.flatnonzero(open_)[::-1].tolist():
            if size[k] <= room:
                pattern[k] = min(room // size[k], max(1, int(left[k])))
                room -= int(pattern[k] * size[k])
        used = np.flatnonzero(pattern)
        k = int(used[(left[used] / pattern[used]).argmin()])
        x[t] = left[k] / pattern[k]
        left = np.maximum(left - x[t] * pattern, 0)
        left[k], open_[k] = 0, False
        basis[:, t] = pattern
    return basis, x


def solve(size: np.ndarray, demand: np.ndarray, capacity: int, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """(pattern, how often), the basis of the linear program min sum x, patterns * x >= demand.

    The revised simplex method; columns are priced by the knapsack, which finds several at once: those that a later
    price makes worth it enter without another knapsack. It ends when
    the lower bound (of the material, or of the prices) shows that no plan can save
    half a sequence or a ten-thousandth, or with the feasible solution after `most`
    pivots. Rounding errors of the inverse can only make a plan longer: what the
    rounded patterns don't hold is counted exactly and packed afterwards.
    """
    m = len(size)
    if not m:
        return []
    basis, x = greedy(size, demand, capacity)
    inverse, cost = np.linalg.inv(basis), np.ones(m)
    material = float(size @ demand) / capacity
    pool = np.zeros((0, m))
    for _ in range(most):
        total = float(cost @ x)
        near = max(0.5, 1e-4 * total)
        if total - material <= near:
            break
        price = cost @ inverse
        surplus = int(price.argmin())
        if price[surplus] < -1e-9:
            column, c = -np.eye(m)[surplus], 0.0
        else:
            worth = pool @ price
            if not len(pool) or worth.max() <= 1 + 1e-7:
                value, found = knapsack(np.maximum(price, 0), size, capacity, FOUND)
                if value <= 1 + 1e-7 or total - total / value <= near:
                    break
                pool = np.concatenate([pool[np.argsort(-worth)[:POOL]], np.array(found, float)])
                worth = pool @ price
                if worth.max() <= 1 + 1e-7:
                    break
            column, c = pool[int(worth.argmax())], 1.0
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        if not np.isfinite(step):
            break
        x = np.maximum(x - step * d, 0)
        x[out] = step
        inverse[out] /= d[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(d[others], inverse[out])
        basis[:, out], cost[out] = column, c
    return [(np.rint(basis[:, j]).astype(np.int64), float(x[j])) for j in range(m) if cost[j] and x[j] > 1e-9]


def plan(demand: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(items of each class, number of sequences): whole patterns that hold at least the demand."""
    kinds = np.array(sorted(k for k, n in demand.items() if n > 0), np.int64)
    want = np.array([demand[k] for k in kinds.tolist()], np.int64)
    out, left = [], want.copy()
    for pattern, x in solve(kinds, want.astype(float), capacity):
        n = int(x + 1e-6)
        if n:
            out.append((pattern, n))
            left -= n * pattern
    # what rounding leaves, at most a few sequences for each pattern: first fit, longest first
    left = np.maximum(left, 0)
    bins: list[tuple[np.ndarray, int]] = []
    for k in range(len(kinds) - 1, -1, -1):
        n = int(left[k])
        for i, (pattern, room) in enumerate(bins):
            take = min(n, room // int(kinds[k]))
            if take:
                pattern[k] += take
                bins[i] = (pattern, room - take * int(kinds[k]))
                n -= take
        per = capacity // int(kinds[k])
        while n:
            pattern = np.zeros(len(kinds), np.int64)
            pattern[k] = min(n, per)
            n -= int(pattern[k])
            bins.append((pattern, capacity - int(pattern[k]) * int(kinds[k])))
    out += [(p, 1) for p, _ in bins]
    return [({int(k): int(a) for k, a in zip(kinds, p, strict=True) if a}, n) for p, n in out]


def slots(patterns: list[tuple[dict[int, int], int]], full: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class, patterns in order: first rank, pieces in a sequence, first sequence. Full pieces come first."""
    base, rank = full, defaultdict(int)
    table: dict[int, list[tuple[int, int, int]]] = defaultdict(list, {SIZE: [(0, 1, 0)]})
    for pattern, n in patterns:
        for k, a in pattern.items():
            table[k].append((rank[k], a, base))
            rank[k] += a * n
        base += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in table.items()}


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's row for each piece of `doc_id, text`."""
    prepare(docs.sparkSession)
    cutted = cut(pieces(docs, tokenizer))
    counts = cutted.groupBy("kind", "part").agg((F.max("place") + 1).alias("count"))
    before = F.sum("count").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = cut(counts.withColumn("before", F.coalesce(before, F.lit(0))))
    demand = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("count").alias("n")).collect()}
    full = demand.pop(SIZE, 0)
    held = docs.sparkSession.sparkContext.broadcast(slots(plan(demand), full))
    ranked = cutted.join(counts.select("kind", "part", "before"), ["kind", "part"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "part")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, rank = b["kind"].to_numpy(), b["rank"].to_numpy()
            sequence = np.zeros(len(b), np.int64)
            for k in np.unique(kind).tolist():
                at = np.flatnonzero(kind == k)
                first, a, base = held.value[k]
                p = np.searchsorted(first, rank[at], "right") - 1
                sequence[at] = base[p] + (rank[at] - first[p]) // a[p]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"])

    rows = ranked.mapInArrow(placed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    # a sequence holds at most SIZE pieces
    ahead = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset", F.coalesce(ahead, F.lit(0)))
