"""Sharding by sampled splitters, in DataFrame operators only: shards of near equal bytes.

Records have a key, the hash of their text, so that copies follow each other. Records
are drawn with a chance in proportion to their size (and, half of it, evenly, so that a
million tiny records don't count as nothing); equally spaced quantiles of the drawn
records are splitters, and the splitters cut the records into ranges. Ranges are counted
exactly. An overfull one, by bytes or by rows, is drawn from again and subdivided
until none is left: as splitters are whole records (key, id and the row's number), even
a third of all rows with one text, or one row repeated as often, falls apart.

Shards are made of consecutive ranges. Where a range would overfill its shard, its
records go to the shard one by one, in the order of their keys, until it is full; the
rest of the range begins the next shard. So a shard ends with the record that
holds its last byte, two shards' bytes differ by no more than two records, and at
most one group of copies is cut at each of the shards' ends. The drawn sample decides which task
sorts what, never the result.

Edge cases: a null text has no bytes (size 1), and the hash and checksum of the empty one;
rows without id come first among their copies; repeated rows take slots of their own;
one record larger than a shard leaves shards behind it empty; an empty table gives an empty
table; columns other than doc_id and text are neither read nor returned by `assign`.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import cut, drop, prepare

SHARDS = 8
#: Ranges at least, records drawn for each range, and how many times the mean of bytes or rows a range may hold.
RANGES, DRAWN, OVERFULL = 256, 32, 3
_ORDER = ("key", "doc_id", "row")
_RECORD = "array<struct<key:bigint,doc_id:bigint,row:bigint>>"


def key_of(text: Column) -> Column:
    """60 bits of the text's hash."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def records(docs: DataFrame) -> DataFrame:
    """`row, doc_id, key, size, text_crc32` of every row, written: the text is read once, and a row keeps its number."""
    text = F.coalesce("text", F.lit(""))
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key_of(F.col("text")).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))


def _list(splitters: list[tuple]) -> Column:
    """The splitters as one constant of the plan."""
    rows = [dict(zip(_ORDER, s, strict=True)) for s in splitters]
    return F.from_json(F.lit(json.dumps(rows)), _RECORD, {"mode": "FAILFAST"})


def range_of(splitters: list[tuple]) -> Column:
    """How many splitters are at or before the record, by bisection."""
    steps = [1 << b for b in range(len(splitters).bit_length() - 1, -1, -1)]
    held, record = _list(splitters), F.struct(*_ORDER)
    passed = lambda at, step: F.coalesce(F.get(held, at + step - 1) <= record, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(passed(at, step), step).otherwise(0))


def _quantiles(drawn: DataFrame, places: dict[int, int]) -> list[tuple]:
    """For each range, places - 1 records that cut its drawn ones evenly."""
    n = F.count("*").over(Window.partitionBy("range"))
    at = F.row_number().over(Window.partitionBy("range").orderBy(*_ORDER))
    parts = F.element_at(F.create_map(*(F.lit(x) for kv in places.items() for x in kv)), F.col("range"))
    cut_ = drawn.select("range", *_ORDER, n.alias("n"), at.alias("at"), parts.alias("parts"))
    # a record is a splitter where the number of the part changes
    cut_ = cut_.where("(at - 1) * parts DIV n <> (at - 2) * parts DIV n AND at > 1")
    return [tuple(r) for r in cut_.select(*_ORDER).collect()]


def _draw(rows: DataFrame, chance: Column) -> DataFrame:
    """Rows drawn by a hash of their number: a task that runs again draws the same."""
    return rows.where(F.pmod(F.xxhash64(F.lit(12), "row"), F.lit(1 << 30)) < chance * (1 << 30))


def _counted(rows: DataFrame, splitters: list[tuple]) -> dict[int, tuple[int, int]]:
    got = rows.groupBy(range_of(splitters).alias("range")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    return {r.range: (r.n, r.bytes) for r in got}


def splitters(rows: DataFrame, ranges: int) -> tuple[list[tuple], dict[int, tuple[int, int]]]:
    """Records that cut the rows into about `ranges` ranges, none overfull, and the rows and bytes of each range.

    The driver holds the splitters and about DRAWN times as many drawn records pass through one window; both grow with `ranges` alone.
    """
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if not total.n:
        return [], {}
    mean_n, mean_bytes = total.n / ranges, total.bytes / ranges
    found: list[tuple] = []
    counts = {0: (total.n, total.bytes)}
    while True:
        # a range of one row can't be subdivided
        full = {r: max(2, round(max(n / mean_n, b / mean_bytes))) for r, (n, b) in counts.items() if n > 1 and (n > OVERFULL * mean_n or b > OVERFULL * mean_bytes)}
        full = {r: min(p, counts[r][0]) for r, p in full.items()}
        if not full:
            return found, counts
        # half by bytes, half by rows; each of a range's parts gets DRAWN records
        rate = {r: DRAWN * p / 2 for r, p in full.items()}
        chances = F.create_map(*(F.lit(x) for r in full for x in (r, F.struct(F.lit(rate[r] / counts[r][1]).alias("byte"), F.lit(rate[r] / counts[r][0]).alias("row")))))
        placed = rows.select(*_ORDER, "size", range_of(found).alias("range")).where(F.col("range").isin(list(full))).withColumn("chance", F.element_at(chances, F.col("range")))
        drawn = _draw(placed, F.col("chance.byte") * F.col("size") + F.col("chance.row"))
        more = set(_quantiles(drawn, full)) - set(found)
        found = sorted({*found, *more}, key=lambda s: (s[0], s[1] is not None, s[1] or 0, s[2]))
        after = _counted(rows, found)
        if not more and after == counts:
            # nothing drawn could cut it further: two or three rows of enormous texts
            return found, counts
        counts = after


def assign(docs: DataFrame, shards: int = SHARDS, ranges: int | None = None) -> DataFrame:
    """`row, doc_id, size, text_crc32, shard, slot` of every row of `doc_id, text`."""
    prepare(docs.sparkSession)
    rows = records(docs)
    # windows spill, so that ranges may hold as much as a partition
    ranges = ranges or max(RANGES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found, counts = splitters(rows, ranges)
    total = sum(b for _, b in counts.values())
    before, n0, b0 = [], 0, 0
    for r in sorted(counts):
        before.append((r, n0, b0))
        n0, b0 = n0 + counts[r][0], b0 + counts[r][1]
    # a row for each range: their number is bounded by the splitters'
    starts = docs.sparkSession.createDataFrame(before, "range int, rows_before long, bytes_before long")
    placed = rows.withColumn("range", range_of(found)).join(F.broadcast(starts), "range")
    order = Window.partitionBy("range").orderBy(*_ORDER)
    ahead = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("rows_before") + F.row_number().over(order) - 1
    # a record goes where its first byte is
    shard = F.expr(f"CAST(least({shards - 1}, (bytes_before + ahead) * {shards} DIV {max(total, 1)}) AS INT)")
    placed = placed.select("*", ahead.alias("ahead"), place.alias("place")).select("row", "doc_id", "size", "text_crc32", shard.alias("shard"), "place")
    placed = cut(placed)
    drop(rows)
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("row", "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The query's row: `doc_id, size, text_crc32, law, shard, slot, grown_shard`."""
    got = assign(docs, shards)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, file_rows: int = 100_000) -> None:
    """Write all columns of `docs` as Parquet folders `shard=0`, `shard=1`, ..., in files of `file_rows` slots each.

    A file is one task's, sorted by slot; a shard of any size is as many files as it needs.
    """
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("_row", "shard", "slot")]
    whole = cut(docs.select(*(F.col(f"`{c}`") for c in names), F.monotonically_increasing_id().alias("_row")))
    # the written copy's row number is the record's id there, so that rows of one id stay apart
    got = assign(whole.select(F.col("_row").alias("doc_id"), "text"), shards).select(F.col("doc_id").alias("_row"), "shard", "slot")
    dealt = whole.join(got.hint("merge"), "_row").drop("_row").withColumn("_file", F.expr(f"slot DIV {file_rows}"))
    files = got.groupBy("shard", F.expr(f"slot DIV {file_rows}")).agg(F.lit(1)).count()
    dealt.repartition(max(1, files), "shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)
    drop(whole)


#: DuckDB SQL of the query: the records in the order of their keys, cut where a shard's bytes end; CRC-32 byte by byte.
ORACLE = f"""
WITH RECURSIVE bits(b, c, i) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, ('0x' || md5(coalesce(text, ''))[:15])::BIGINT AS key FROM documents),
x AS (
  SELECT doc_id, size, key,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ')[:size - 1], lambda h: ('0x' || h)::BIGINT)),
      lambda s, v: xor(s >> 8, t[(xor(s, v) & 255) + 1]))) AS text_crc32
  FROM d, crc),
o AS (
  SELECT *, sum(size) OVER w - size AS ahead, row_number() OVER w - 1 AS place, sum(size) OVER () AS total
  FROM x WINDOW w AS (ORDER BY key, doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST(least({SHARDS - 1}, ahead * {SHARDS} // total) AS INTEGER) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
