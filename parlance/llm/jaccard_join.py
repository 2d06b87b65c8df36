"""N-gram Jaccard join through a token-group matrix.

Documents are sets of 5-word shingles (64-bit hashes). Equal sets are collapsed
to classes first, which have numbers of their own: what is linked are sets, not
ids. Of each set, a prefix is kept: in one global order of shingles, the
common ones last, two sets of Jaccard similarity 0.8 share `need` shingles of
their prefixes of length n - ceil(0.8 n) + need, and the first shingle that they
share leaves enough shingles behind it in both. So the prefixes lose no link.

1. Groups. Every prefix shingle names a leader, its most central document; the
   documents whose similarity to their leader is verified form a group with it,
   which is one component by construction.
2. Matrix. For each group, the union of its members' prefix shingles, with the
   largest rest behind each and the smallest set size.
3. Queries. Every document is held against the matrix. The bound on its overlap
   with a group comes from the shingles they share; groups that reach what 0.8
   needs are opened, their members compared by prefix, and what is left is
   verified on the whole texts.

The order of shingles only moves work around: any order gives the same links.
Shingles count as common by how often chunks of the corpus repeat them; every
document is counted, and the table is held at `COMMON` entries.

Edge cases: a null, empty or wordless text has no shingles and stands alone;
fewer than five words are one shingle; equal sets are one class, of any size; a
text of any length is read whole. Every row is returned: of rows that share an id,
each has the links of its own text, and the component of its own set. A document
without id has no component. An empty table gives an empty table; other columns are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import common
from parlance.llm.common import cut, drop, prepare, release
from parlance.llm.components import components

WORDS = 5
#: Entries of the table of common shingles, which every executor holds: 16 bytes each.
COMMON = 1 << 18
#: Shingles of one chunk in which repeated ones are counted.
CHUNK = 1 << 22


def shingle_sets(texts: pa.Array, k: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingles sorted within rows, where each row's begin with the total appended)."""
    for i, buf, off in common.slices(texts):
        h, first, _, _ = common.words_of(buf, off, lower=True)
        w, at = common.windows(h, first, k)
        row = np.searchsorted(first, at, "right") - 1
        size = np.diff(first)
        short = np.flatnonzero((size > 0) & (size < k))
        if len(short):
            p = common.powers(k + 1)
            one = [common.mix((h[first[r] : first[r + 1]] * p[: size[r]]).sum(keepdims=True) ^ np.uint64(size[r] + 1))[0] for r in short]
            w, row = np.concatenate([w, np.array(one, np.uint64)]), np.concatenate([row, short])
            by = np.argsort(row, kind="stable")
            w, row = w[by], row[by]
        cuts = np.searchsorted(row, np.arange(len(off)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            w[a:b].sort()
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (row[1:] != row[:-1])
        w, row = w[new], row[new]
        yield i, w, np.searchsorted(row, np.arange(len(off)))


def _sums(w: np.ndarray, cuts: np.ndarray, salt: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(w ^ np.uint64(salt)), dtype=np.uint64)])
    return total[cuts[1:]] - total[cuts[:-1]]


SKETCH = "doc_id long, n long, k1 long, k2 long, token long, times long"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: its set's size and 128-bit key. And rows without size: shingles that different sets of a chunk share, and how many have each."""
    names = [x.split()[0] for x in SKETCH.split(", ")]
    parts: list[np.ndarray] = []
    size, seen = 0, set()

    def counted() -> pa.RecordBatch:
        w, n = np.unique(np.concatenate(parts), return_counts=True)
        w, n = w[n > 1], n[n > 1]
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(w), pa.int64())] * 4, pa.array(w.view(np.int64)), pa.array(n)], names=names)

    for b in batches:
        n, k1, k2 = (np.zeros(len(b), np.int64) for _ in range(3))
        for i, w, cuts in shingle_sets(b["text"]):
            to = slice(i, i + len(cuts) - 1)
            n[to] = np.diff(cuts)
            k1[to], k2[to] = _sums(w, cuts, 0x51).view(np.int64), _sums(w, cuts, 0xA7F3).view(np.int64)
            for r, x in enumerate(k1[to].tolist()):
                if x not in seen:
                    seen.add(x)
                    parts.append(w[cuts[r] : cuts[r + 1]])
                    size += len(parts[-1])
            if size >= CHUNK:
                yield counted()
                parts, size, seen = [], 0, set()
        yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(n), pa.array(k1), pa.array(k2), *[pa.nulls(len(b), pa.int64())] * 2], names=names)
    if parts:
        yield counted()


def common_shingles(sketch: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The shingles with the highest counts, sorted, and their counts: at most `most`, from all documents."""
    counts = cut(sketch.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("n")).where("n > 2"))
    step = F.floor(F.log2("n") * 4).cast("int")
    level, total = 0, 0
    for r in sorted(counts.groupBy(step.alias("level")).count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            level = r.level + 1
            break
    top = counts.where(step >= level).toPandas()
    drop(counts)
    by = np.argsort(token := top.token.to_numpy(np.int64).view(np.uint64))
    return token[by], top.n.to_numpy(np.int64)[by]


def need(n: np.ndarray) -> np.ndarray:
    """Prefix shingles that two similar sets share at least, by the size of the smaller."""
    return np.where(n < 20, 1, np.where(n < 100, 2, 3))


NEED = "CASE WHEN {n} < 20 THEN 1 WHEN {n} < 100 THEN 2 ELSE 3 END"


def prefixes(docs: DataFrame, table: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """`doc_id, key, n, k1, k2, central, tokens`: the text's hash, the set's size and key, the mean log count of all its shingles, and its prefix in the global order."""
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = held.value
        for b in batches:
            ids, key, size, k1, k2, central, tokens = [], [], [], [], [], [], []
            doc = b["doc_id"].cast(pa.int64())
            for i, w, cuts in shingle_sets(b["text"]):
                n = np.diff(cuts)
                row = np.repeat(np.arange(len(n)), n)
                if len(token):
                    at = np.minimum(np.searchsorted(token, w), len(token) - 1)
                    c = np.where(token[at] == w, count[at], 0)
                else:
                    c = np.zeros(len(w), np.int64)
                by = np.arange(len(w))
                for r in np.unique(row[c > 0]).tolist():  # shingles are in order already where none is common
                    at = slice(cuts[r], cuts[r + 1])
                    by[at] = by[at][np.argsort(c[at], kind="stable")]
                place = np.arange(len(w)) - np.repeat(cuts[:-1], n)
                length = n - (4 * n + 4) // 5 + need(n)
                keep = place < np.repeat(np.minimum(length, n), n)
                kept = w[by][keep].view(np.int64)
                ends = np.cumsum(np.minimum(length, n))
                weight = np.bincount(row, np.log2(1 + c), len(n)) / np.maximum(n, 1)
                ids.append(doc[i : i + len(n)])
                key.append(b["key"][i : i + len(n)])
                k1.append(_sums(w, cuts, 0x51).view(np.int64))
                k2.append(_sums(w, cuts, 0xA7F3).view(np.int64))
                size.append(n)
                central.append(weight)
                tokens.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(kept)))
            if ids:
                numbers = [pa.array(np.concatenate(x)) for x in (size, k1, k2, central)]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(key), *numbers, pa.concat_arrays(tokens)], names=["doc_id", "key", "n", "k1", "k2", "central", "tokens"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, n long, k1 long, k2 long, central double, tokens array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The `a, b` pairs whose whole texts (`node, text`) have 100 * intersection >= 80 * union."""
    two = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    two = two.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def sets(ids: list[int], column: pa.Array) -> dict[int, np.ndarray]:
        first = dict(zip(reversed(ids), range(len(ids) - 1, -1, -1), strict=True))
        out, keys = {}, list(first)
        for i, w, cuts in shingle_sets(column.take(pa.array(list(first.values())))):
            out.update({keys[i + r]: w[cuts[r] : cuts[r + 1]] for r in range(len(cuts) - 1)})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 100):
                part = whole.slice(i, 100)
                a, b = part["a"].to_pylist(), part["b"].to_pylist()
                sa, sb = sets(a, part["text_a"]), sets(b, part["text_b"])
                good = []
                for x, y in zip(a, b, strict=True):
                    both = len(np.intersect1d(sa[x], sb[y], assume_unique=True))
                    good.append(100 * both >= 80 * (len(sa[x]) + len(sb[y]) - both))
                part = part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
                if len(part):
                    yield part

    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


#: Shingles that two sets of these sizes share at least, if they are similar.
OVERLAP = "ceil(4 * ({a} + {b}) / 9D - 1e-9)"


def groups(docs: DataFrame) -> DataFrame:
    """`doc_id, n_shingles, component_id` of every row of `doc_id, text`."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(docs.mapInArrow(_sketch, SKETCH))
    sets = sketch.where("n IS NOT NULL").select("doc_id", "n", "k1", "k2")
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))

    # rows that repeat an id and a set meet before the shuffle
    docs = docs.where("doc_id IS NOT NULL").withColumn("key", F.xxhash64("text"))
    prefix = prefixes(docs, common_shingles(sketch)).groupBy("doc_id", "k1", "k2", "n").agg(F.min(F.struct("key", "central", "tokens")).alias("x"))
    prefix = cut(prefix.join(classes.withColumnRenamed("rep", "doc_id").hint("merge"), ["doc_id", "k1", "k2", "n"]).select("node", "doc_id", F.col("n").cast("int").alias("n"), "x.*"))
    posting = prefix.select("node", "n", F.round(-F.col("central"), 3).cast("float").alias("lead"), F.posexplode("tokens").alias("place", "token"))
    posting = posting.withColumn("rest", F.col("n") - F.col("place")).drop("place")
    # the most central set leads, then the smaller number
    leaders = cut(posting.groupBy("token").agg(F.min(F.struct("lead", "node", "n", "rest")).alias("first"), F.count("*").alias("of")).where("of > 1").drop("of"))
    posting = cut(posting.drop("lead").join(leaders.hint("merge"), "token"))
    drop(leaders)
    release(spark)
    used = posting.select("node").distinct().join(prefix.select("node", "doc_id", "key"), "node")
    texts = cut(docs.join(used.hint("merge"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("node", "text"))
    drop(prefix)
    release(spark)

    star = posting.where("node <> first.node")
    star = star.where(f"5 * least(n, first.n) >= 4 * greatest(n, first.n) AND least(rest, first.rest) >= {OVERLAP.format(a='n', b='first.n')}")
    star = star.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(verified(star, texts))
    release(spark)
    label = components(links)

    # the matrix: of each group, shingles with the largest rest, and the smallest and largest set that has them
    member = label.select("node", F.col("label").alias("group"))
    grouped = posting.drop("first").join(member, "node", "left").select("token", "node", "n", "rest", F.coalesce("group", "node").alias("group"))
    several = grouped.groupBy("token").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 < g1").select("token")
    grouped = cut(grouped.join(several, "token"))
    drop(posting, label)
    matrix = grouped.groupBy("token", "group").agg(F.max("rest").alias("g_rest"), F.min("n").alias("g_min"), F.max("n").alias("g_max"))
    # a pair of groups is opened from the one with the smaller number, so that no pair is met twice
    # (of the `need` shingles that a pair shares in any case, the last has 2 fewer behind it than the first)
    query = grouped.join(matrix.withColumnRenamed("group", "g"), "token").where(f"group < g AND 5 * n >= 4 * g_min AND 5 * g_max >= 4 * n AND least(rest, g_rest) >= {OVERLAP.format(a='n', b='greatest(g_min, ceil(4 * n / 5D))')} - 2")
    opened = query.select("token", "node", "n", "rest", "g")
    member = grouped.select("token", F.col("group").alias("g"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("rest").alias("b_rest"))
    met = opened.join(member, ["token", "g"]).where("5 * least(n, m) >= 4 * greatest(n, m)")
    met = met.groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("shared"), F.max(F.expr(f"least(rest, b_rest) - {OVERLAP.format(a='n', b='m')}")).alias("spare"), F.min(F.least("n", "m")).alias("least"))
    met = met.where(f"spare >= 0 AND shared >= {NEED.format(n='least')}")
    more = cut(links.union(verified(met, texts)))
    drop(grouped, texts, links)
    release(spark)
    label = components(more)
    drop(more)

    # a component's id is the smallest of its classes'; both tables are written, so that a large component or class can be split in the joins
    linked = cut(label.select("node", "label").join(classes.select("node", "rep"), "node"))
    least = cut(linked.groupBy("label").agg(F.min("rep").alias("component_id")))
    linked = linked.join(least.hint("merge"), "label").select("node", "component_id")
    named = cut(classes.join(linked.hint("merge"), "node", "left").select("k1", "k2", "n", F.coalesce("component_id", "rep").alias("component_id")))
    drop(label, classes, least)
    named = sets.join(named.hint("merge"), ["k1", "k2", "n"], "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.expr("CASE WHEN doc_id IS NOT NULL THEN coalesce(component_id, doc_id) END").alias("component_id"))


#: DuckDB SQL of the query, for tables whose ids are unique.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w WHERE len(w) >= 5),
s AS (
  SELECT DISTINCT doc_id, concat_ws(' ', x, lead(x) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS s
  FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(x, 4) OVER o IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
pair AS (SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)),
reach(a, b) AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = w.doc_id
"""
