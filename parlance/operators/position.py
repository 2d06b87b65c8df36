"""Row positions without one task that sees every row: in the order of a unique numeric key, or of files."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.naming import but, fresh

#: Key ranges that rows are numbered in; their counts are the only rows of the one-task window.
RANGES = 1024


def numbered(df: DataFrame, key: str, name: str = "position", ranges: int = RANGES) -> DataFrame:
    """Add the 0-based position of each row by `key` (numeric and unique; rows with a null key come last).

    Approximate quantiles, from one pass over the keys, cut them into ranges of about equal counts, however
    they are spread; rows are numbered within a range and the counts of the ranges before are added.
    """
    marks = sorted(set(df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    splits = [float("-inf"), *(marks or [0.0]), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_key", outputCol="_range", handleInvalid="keep").transform(df.withColumn("_key", F.col(key).cast("double"))).drop("_key")
    ranged = ranged.withColumn("_range", F.coalesce("_range", F.lit(float(len(splits)))))
    before = F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("_range").count().select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_last(key))) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")


def in_files(df: DataFrame, name: str = "position") -> tuple[DataFrame, int]:
    """Add the 0-based position of each row of `df`, a plain scan of files: files by path, rows as they stand in them. And the number of rows.

    A scan reads each file in splits, and a split's rows follow each other in one task. So a row's position is its
    place in its split, and the rows of the splits before: those are counted by a first scan, a row for each split comes
    to the driver, and the sums go back with them. Rows themselves are neither shuffled nor sorted. Both scans must find
    the same files; that the second one has as many rows in each split isn't checked.
    """
    path, block, row = fresh(df.columns, "_path", "_block", "_row")
    placed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(row))
    splits = sorted(tuple(r) for r in placed.groupBy(path, block).agg(F.min(row), F.count("*")).collect())
    starts, n = [], 0
    for p, b, first, count in splits:
        starts.append((p, b, n - first))
        n += count
    shift = fresh(placed.columns, "_shift")[0]
    table = df.sparkSession.createDataFrame(starts, f"{path} string, {block} long, {shift} long")
    # a row for each split of the scan, whose driver holds as many already
    return placed.join(F.broadcast(table), [path, block]).select(*but(df, ()), (F.col(row) + F.col(shift)).alias(name)), n
