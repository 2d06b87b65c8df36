"""Line deduplication by pairwise alignment.

Lines are hashed. A line alone is often too common to tell anything ("Read
more"), but lines that follow each other until they have `BLOCK` words are rare:
from every line on, and back from every line, such a run of lines is a hash (a
line of `BLOCK` words is a run by itself). A document overlaps with the first
document, the one with the smallest id, that has one of its runs, and is aligned
with it: patience diff over the runs that both share, that is, those that are
unique on both sides in their longest increasing order, then the gaps between them
in the same way. Moved and repeated runs, which no order holds, are left for another
alignment with the same document, until nothing is left. Aligned runs that follow each other on both sides are
common blocks, and go from the later document; nothing else goes.

Every block of consecutive lines with `BLOCK` words together that a document shares
with any earlier one consists of such runs, and each run has a first document. So
nothing that an alignment with every earlier document finds is lost, however many
documents share it and in whatever order; each run meets one document only, so that
the work is linear in the lines. Wordless lines don't count, and go with the lines
around them. A block keeps its copy in the document that it was first in.

Edge cases: null text stays null, and empty text empty; a line repeated within a
document is no duplicate by itself; rows with one id are no duplicates of each
other, whatever their texts, and rows without id are left as they are; a document
that earlier ones hold in full becomes empty; a text of any length is read whole; an
empty table gives an empty table; other columns stay as they are, but for `n_lines`,
`doomed` and `blocks`, which `dedup` adds or replaces.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import common
from parlance.llm.common import cut, drop, prepare

BLOCK = 8
#: Alignments in order with one earlier document; few documents need a third one.
PASSES = 16
Line = tuple[int, int]  # place, run


def _runs(row: np.ndarray, h: np.ndarray, words: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, last line and hash of the shortest runs of `block` words from each line on and back from it, within a row."""
    z = np.cumsum(words)
    a = z - words
    n = np.arange(len(row))
    last = np.searchsorted(z, a + block)
    first = np.searchsorted(a, z - block, "right") - 1
    # a run has at most `block` lines, as each has a word
    key = np.unique(np.concatenate([(n * (block + 1) + last - n)[last < len(row)], (first * (block + 1) + n - first)[first >= 0]]))
    i, j = key // (block + 1), key // (block + 1) + key % (block + 1)
    same = row[i] == row[j]
    i, j = i[same], j[same]
    run = common.mix(h[i] + common.powers(2)[1])
    for k in range(1, int((j - i).max(initial=0)) + 1):
        more = np.flatnonzero(i + k <= j)
        run[more] = common.mix(run[more] * common.powers(2)[1] + h[i[more] + k])
    return i, j, run


def _lines(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """A row for each document and different run: its hash, and its places, each the number of the first line times 2^32 and that of the last."""
    for b in batches:
        doc, key = b["doc_id"].cast(pa.int64()).to_numpy(), b["key"].to_numpy()
        for at, buf, off in common.slices(b["text"]):
            nl = np.flatnonzero(buf == 10)
            start = np.sort(np.concatenate([off[:-1], nl + 1]))
            row = np.sort(np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, nl, "right") - 1]))
            end = np.minimum(np.append(nl, len(buf))[np.searchsorted(nl, start)], off[row + 1])
            number = np.arange(len(row)) - np.searchsorted(row, row)
            ws, we = common.word_bounds(buf, off)
            a, z = np.searchsorted(ws, start), np.searchsorted(ws, end)
            full = z > a
            # a line without the white space around it
            h = common.span_hashes(buf, ws[a[full]], we[z[full] - 1])
            row, number, words = row[full], number[full], (z - a)[full]
            i, j, run = _runs(row, h, words, block)
            if not len(i):
                continue
            run, row, place = run.view(np.int64), row[i], number[i] << 32 | number[j]
            by = np.lexsort((place, run, row))
            run, row, place = run[by], row[by], place[by]
            new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (row[1:] != row[:-1])]))
            places = pa.ListArray.from_arrays(pa.array(np.append(new, len(run)).astype(np.int32)), pa.array(place))
            yield pa.RecordBatch.from_arrays([pa.array(doc[at + row[new]]), pa.array(key[at + row[new]]), pa.array(run[new]), places], names=["doc_id", "key", "h", "at"])


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting: of equally long ones, the one with the latest places from its end."""
    tops: list[int] = []
    tails: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            tails.append(i)
        else:
            tops[k], tails[k] = v, i
        back[i] = tails[k - 1] if k else -1
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[Line], b: list[Line]) -> list[tuple[int, int]]:
    """Aligned places of two documents' runs, both ascending; at least one pair if they have a run in common."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0][1] == b[b0][1]:
            found.append((a[a0][0], b[b0][0]))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1][1] == b[b1 - 1][1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a[a1][0], b[b1][0]))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = _places(a, a0, a1), _places(b, b0, b1)
        once = sorted((x[0], in_b[h][0]) for h, x in in_a.items() if len(x) == 1 == len(in_b.get(h, ())))
        if once:
            anchors = [once[k] for k in _increasing([j for _, j in once])]
            i0, j0 = a0, b0
            for i, j in anchors:
                found.append((a[i][0], b[j][0]))
                todo.append((i0, i, j0, j))
                i0, j0 = i + 1, j + 1
            todo.append((i0, a1, j0, b1))
        else:
            # nothing is unique: the n-th place of a run goes with its n-th one there, as far as the order holds
            both = sorted((i, j) for h, x in in_a.items() for i, j in zip(x, in_b.get(h, ()), strict=False))
            found += [(a[i][0], b[j][0]) for i, j in (both[k] for k in _increasing([j for _, j in both]))]
    return sorted(found)


def _places(lines: list[Line], first: int, end: int) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i in range(first, end):
        out.setdefault(lines[i][1], []).append(i)
    return out


def alignments(here: list[Line], there: list[Line]) -> dict[int, int]:
    """The place there of every place here that an alignment reaches.

    Blocks that were moved or repeated break the order, so that what an alignment leaves here is aligned again with
    the earlier document, until nothing is left. What `PASSES` alignments have left, as of lines in reverse, has its n-th place of a
    run aligned with the n-th one there, from the first one again after the last.
    """
    out: dict[int, int] = {}
    for _ in range(PASSES):
        out.update(found := patience(here, there))
        here = [x for x in here if x[0] not in out]
        if not here or not found:
            return out
    at = {h: [there[j][0] for j in x] for h, x in _places(there, 0, len(there)).items()}
    for h, x in _places(here, 0, len(here)).items():
        out.update((here[i][0], at[h][k % len(at[h])]) for k, i in enumerate(x))
    return out


def aligned(shared: list[tuple[list[int], list[int]]]) -> list[tuple[int, int, int]]:
    """Common blocks (first line, last line, first line there) with one earlier document, from the places of each shared run here and there: the aligned ones, and no others."""
    here = sorted((i, k) for k, (at, _) in enumerate(shared) for i in at)
    there = sorted((j, k) for k, (_, at) in enumerate(shared) for j in at)
    out: list[tuple[int, int, int]] = []
    for i, j in sorted(alignments(here, there).items()):
        first, last, j = i >> 32, i & 0xFFFFFFFF, j >> 32
        if out and first - out[-1][0] == j - out[-1][2] and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]), out[-1][2])
        else:
            out.append((first, last, j))
    return out


def duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """`doc_id, key, blocks` of documents with any: the blocks to delete, with the earlier document that has each; `key` is the text's hash."""
    keyed = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    lines = cut(keyed.mapInArrow(partial(_lines, block=block), "doc_id long, key long, h long, at array<long>"))
    # a run's first document comes from partial minima, and is written: so both sides of the join are plain, and a hot run can be split
    held = lines.groupBy("h").agg(F.min(F.struct("doc_id", "key", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    held = cut(held.select("h", F.col("first.doc_id").alias("holder"), F.col("first.at").alias("there")))
    # joins are shuffled at every size: neither side has a bound that would let it be broadcast
    shared = lines.join(held.hint("merge"), "h").where("doc_id > holder")
    # as many places there as here, and one more, which tells whether the run is unique there: a document's rows stay as long as itself
    shared = shared.select("doc_id", "key", "holder", "at", F.slice("there", F.lit(1), F.size("at") + 1).alias("there"))

    def align(table: pa.Table) -> pa.Table:
        by = defaultdict(list)
        for holder, at, there in zip(*(table[c].to_pylist() for c in ("holder", "at", "there")), strict=True):
            by[holder].append((at, there))
        blocks = sorted((first, last, holder, j) for holder, runs in by.items() for first, last, j in aligned(runs))
        blocks = [{"first": a, "last": z, "holder": e, "there": j} for a, z, e, j in blocks]
        return pa.table({"doc_id": table["doc_id"][:1], "key": table["key"][:1], "blocks": pa.array([blocks], pa.list_(pa.struct(_BLOCK)))})

    # rows that repeat an id and a text meet before the shuffle
    out = cut(shared.distinct().groupBy("doc_id", "key").applyInArrow(align, f"doc_id long, key long, blocks {BLOCKS}"))
    drop(lines, held)
    return out


_BLOCK = [("first", pa.int32()), ("last", pa.int32()), ("holder", pa.int64()), ("there", pa.int32())]
BLOCKS = "array<struct<first:int,last:int,holder:bigint,there:int>>"


def without(text: str, ranges: list[int]) -> tuple[str, list[int]]:
    """The text without the lines from each even entry to the next one, and without the wordless lines between deleted ones; and their numbers."""
    lines = text.split("\n")
    gone = np.zeros(len(lines), bool)
    for a, z in zip(ranges[::2], ranges[1::2], strict=True):
        gone[a : z + 1] = True
    at = np.flatnonzero(gone).tolist()
    for a, z in zip(at, at[1:], strict=False):
        if z > a + 1 and not "".join(lines[a + 1 : z]).strip(" \t\n\r\x0b\x0c"):
            gone[a:z] = True
    return "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), np.flatnonzero(gone).tolist()


def dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """`docs` with `text` reduced, and the columns `n_lines`, `doomed` (numbers of the deleted lines, or null) and `blocks` (where each block was found, or null)."""
    prepare(docs.sparkSession)

    @F.pandas_udf("text string, doomed array<int>")
    def reduced(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = [(t, None) if t is None or r is None else without(t, list(r)) for t, r in zip(texts, ranges, strict=True)]
        return pd.DataFrame({"text": pd.Series([t for t, _ in rows], dtype=object), "doomed": pd.Series([d for _, d in rows], dtype=object)})

    # its rows are the same each time; so named, a filter on its result isn't pushed below it with a second call
    once = reduced.asNondeterministic()
    names = [c for c in docs.columns if c not in ("n_lines", "doomed", "blocks")]
    found = duplicates(docs, block).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "blocks")
    joined = docs.select(*(F.col(f"`{c}`") for c in names)).withColumn("n_lines", F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)))
    joined = joined.join(found.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left")
    joined = joined.withColumn("_new", once("text", F.flatten(F.transform("blocks", lambda b: F.array(b["first"], b["last"])))))
    return joined.select(*(F.col("_new.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names), "n_lines", F.col("_new.doomed").alias("doomed"), "blocks")


def report(docs: DataFrame) -> DataFrame:
    """The query's row: `doc_id, n_lines, n_deleted, deleted, text, holders, found` of each document; `holders` are the earlier documents of its blocks, and `found` says where each block was first."""
    found = F.transform("blocks", lambda b: F.concat(b["first"].cast("string"), F.lit("-"), b["last"].cast("string"), F.lit("="), b["holder"].cast("string"), F.lit(":"), b["there"].cast("string")))
    holders = F.array_sort(F.array_distinct(F.transform("blocks", lambda b: b["holder"])))
    reduced = dedup(docs.select("doc_id", "text"))
    return reduced.select(
        "doc_id",
        F.col("n_lines").cast("long"),
        F.coalesce(F.size("doomed"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.array_join("doomed", ","), F.lit("")).alias("deleted"),
        "text",
        F.coalesce(F.array_join(holders.cast("array<string>"), ","), F.lit("")).alias("holders"),
        F.coalesce(F.array_join(found, ","), F.lit("")).alias("found"),
    )


#: DuckDB SQL of the query, for tables whose ids are unique: the lines of every run that an earlier document has, without the alignment that says where.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, i, x, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM l),
w AS (
  SELECT doc_id, i, n, row_number() OVER o AS k, sum(n) OVER o AS z, list(t) OVER (o ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ts
  FROM s WHERE n > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (
  SELECT a.doc_id, a.k AS k0, b.k AS k1, array_to_string(a.ts[:b.k - a.k + 1], chr(10)) AS run
  FROM w a JOIN range(8) d ON true JOIN w b ON b.doc_id = a.doc_id AND b.k = a.k + d.range
  WHERE b.z - a.z + a.n >= 8 AND (b.k = a.k OR b.z - b.n - a.z + a.n < 8 OR b.z - a.z < 8)),
f AS (SELECT run, min(doc_id) AS holder FROM r GROUP BY run),
hit AS (SELECT r.doc_id, k0, k1, holder FROM r JOIN f USING (run) WHERE r.doc_id > holder),
g AS (SELECT DISTINCT doc_id, unnest(range(k0, k1 + 1)) AS k FROM hit),
m AS (SELECT doc_id, i, x, n, sum((n > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
e AS (
  SELECT m.doc_id, m.i, m.x, g.k IS NOT NULL AND (m.n > 0 OR h.k IS NOT NULL) AS gone
  FROM m LEFT JOIN g ON g.doc_id = m.doc_id AND g.k = m.k LEFT JOIN g h ON h.doc_id = m.doc_id AND h.k = m.k + 1),
t AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (gone) AS deleted, string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone) AS text
  FROM e GROUP BY doc_id),
p AS (SELECT doc_id, string_agg(holder::VARCHAR, ',' ORDER BY holder) AS holders FROM (SELECT DISTINCT doc_id, holder FROM hit) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(deleted, '') AS deleted,
  CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text, coalesce(holders, '') AS holders
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id
"""
