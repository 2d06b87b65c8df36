"""Rater agreement: item and protocol level, kappa, confusion matrix and distributions.

Each aggregate is one pass with partial sums on the map side; `by` reports it for
groups. Rows where a score is null take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.position import numbered

MAX_SCORE, ITEMS, WIDE, NEAR = 6, 20, 10, 0.05


def _both(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull())


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def _kappa_parts(a: Column, b: Column, most: int) -> tuple[Column, Column]:
    """Observed and expected agreement with quadratic weights, from moments."""
    a, b, m = a.cast("double"), b.cast("double"), float(most * most)
    return 1 - F.avg((a - b) * (a - b)) / m, 1 - (F.avg(a * a) + F.avg(b * b) - 2 * F.avg(a) * F.avg(b)) / m


def weighted_kappa_ratio(a: Column, b: Column, most: int = MAX_SCORE) -> Column:
    """Observed over expected agreement; 1 if none is expected. Can exceed 1."""
    po, pe = _kappa_parts(a, b, most)
    return F.when(pe == 0, 1.0).otherwise(po / F.nullif(pe, F.lit(0.0)))


def weighted_kappa(a: Column, b: Column, most: int = MAX_SCORE) -> Column:
    """The textbook coefficient (po - pe) / (1 - pe); 1 if all is expected."""
    po, pe = _kappa_parts(a, b, most)
    return F.when(pe == 1, 1.0).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))


def percent_agreement(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Share of equal values, numbers or (case-sensitive) strings."""
    return df.groupBy(*by or []).agg(_share(F.col(a) == F.col(b)).alias("agreement"))


def kappa(df: DataFrame, a: str, b: str, most: int = MAX_SCORE, by: list[str] | None = None) -> DataFrame:
    x, y = F.col(a), F.col(b)
    return _both(df, a, b).groupBy(*by or []).agg(weighted_kappa_ratio(x, y, most).alias("kappa_ratio"), weighted_kappa(x, y, most).alias("kappa"))


def item_agreement(df: DataFrame, auto: str, human: str, most: int = MAX_SCORE, by: list[str] | None = None) -> DataFrame:
    """Difference statistics, exact and near agreement, kappa and problem cases."""
    d = F.abs(F.col(auto) - F.col(human))
    return _both(df, auto, human).groupBy(*by or []).agg(
        F.count("*").alias("n"),
        F.avg(d).alias("mean_diff"),
        F.stddev_pop(d).alias("std_diff"),
        F.max(d).alias("max_diff"),
        F.min(d).alias("min_diff"),
        _share(d == 0).alias("exact"),
        _share(d <= 1).alias("within_1"),
        _share(d <= 2).alias("within_2"),
        weighted_kappa_ratio(F.col(auto), F.col(human), most).alias("kappa_ratio"),
        F.count_if(d > 2).alias("problem_cases"),
        _share(d > 2).alias("problem_rate"),
    )


def _protocols(df: DataFrame, auto: str, human: str, key: str, items: int) -> DataFrame:
    """Difference of the totals of each whole chunk of `items` rows in the order of `key`; the rest is dropped."""
    chunk = numbered(df.select(key, auto, human), key).withColumn("protocol", F.floor(F.col("position") / items))
    sums = chunk.groupBy("protocol").agg(F.count("*").alias("rows"), F.sum(auto).alias("a"), F.sum(human).alias("h"))
    return sums.where(F.col("rows") == items).select("protocol", F.abs(F.col("a") - F.col("h")).alias("diff"))


def protocol_agreement(df: DataFrame, auto: str, human: str, key: str, items: int = ITEMS, most: int = MAX_SCORE) -> DataFrame:
    """Agreement of protocol totals; without a whole protocol n_protocols is 0 and the rest null."""
    d = F.col("diff")
    return _protocols(df, auto, human, key, items).agg(
        F.count("*").alias("n_protocols"),
        F.lit(items * most).alias("max_total"),
        F.avg(d).alias("mean_diff"),
        F.stddev_pop(d).alias("std_diff"),
        F.max(d).alias("max_diff"),
        _share(d <= WIDE).alias("within_10_pts"),
        _share(d <= NEAR * items * most).alias("within_5_percent"),
    )


def score_difference_stats(df: DataFrame, auto: str, human: str, key: str, items: int = ITEMS) -> DataFrame:
    """Mean, RMSE, maximum and near share of protocol differences; without a whole protocol, of one difference over all rows."""
    whole = df.agg(F.abs(F.sum(auto) - F.sum(human)).alias("all"))
    d = F.col("diff").cast("double")
    got = _protocols(df, auto, human, key, items).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(d).alias("max"), _share(d <= WIDE).alias("within_10"))
    some, every = F.col("n") > 0, F.col("all").cast("double")
    return got.crossJoin(F.broadcast(whole)).select(
        F.when(some, F.col("n")).when(every.isNotNull(), 1).otherwise(0).cast("bigint").alias("n_protocols"),
        F.coalesce("mean", every).alias("mean_diff"),
        F.coalesce("rmse", every).alias("rmse"),
        F.coalesce("max", every).alias("max_diff"),
        F.coalesce("within_10", (every <= WIDE).cast("double")).alias("within_10"),
    )


#: Different labels that a matrix of found labels may have: its grid has the square of that many rows.
LABELS = 1000


def confusion_matrix(df: DataFrame, predicted: str, actual: str, labels: list[int] | None = None, most: int = LABELS) -> DataFrame:
    """Long form: a count for each actual and predicted label, zeros included; other labels are dropped.

    Without `labels`, the labels that occur: more than `most` of them are an error, for which `frequent_labels` names those that
    matter. The label grid is labels x labels, of a size that the labels fix.
    """
    spark = df.sparkSession
    pairs = df.groupBy(F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")).count()
    if labels is None:
        values = pairs.select(F.col("actual").alias("x")).union(pairs.select("predicted")).where("x IS NOT NULL").distinct()
        if values.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} different labels: name them, or take frequent_labels")
    else:
        values = spark.createDataFrame([(int(x),) for x in labels], "x int").distinct()
    grid = values.select(F.col("x").alias("actual")).crossJoin(values.select(F.col("x").alias("predicted")))
    return grid.join(pairs, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))


def frequent_labels(df: DataFrame, *columns: str, share: float = 0.01) -> DataFrame:
    """`label, n` of the values that at least this share of all values of the columns has, with their exact counts; nulls aren't counted.

    One pass keeps at most 1 / share candidates for each task (Misra and Gries' summary, which merges and misses no frequent
    value); a second one counts those alone. Neither shuffles the labels.
    """
    values = reduce(DataFrame.unionAll, (df.select(F.col(c).alias("label")) for c in columns)).where("label IS NOT NULL")
    # at half the share, as the summary's own share is rounded
    [found] = values.freqItems(["label"], max(1e-4, share / 2)).first()
    counted = values.agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == F.lit(x)).alias(f"n{i}") for i, x in enumerate(found or []))).first()
    rows = [(x, counted[f"n{i}"]) for i, x in enumerate(found or []) if counted[f"n{i}"] >= share * counted["n"]]
    return df.sparkSession.createDataFrame(rows, f"label {values.dtypes[0][1]}, n long")


def quantiles(df: DataFrame, column: str, probabilities: list[float], by: list[str] | None = None, error: float = 0.001) -> DataFrame:
    """`probability, value` of each group, from summaries that merge: the share of values below is within `error` of the probability.

    `describe` has the exact median, for which a group's values meet in one task; this needs some 1 / error numbers a task and group.
    """
    values = F.percentile_approx(column, list(probabilities), round(1 / error))
    step = df.groupBy(*by or []).agg(F.arrays_zip(F.array(*map(F.lit, probabilities)).alias("probability"), values.alias("value")).alias("_q"))
    return step.select(*by or [], F.explode("_q").alias("_q")).select(*by or [], F.col("_q.probability").alias("probability"), F.col("_q.value").alias("value"))


def confusion_table(df: DataFrame, predicted: str, actual: str, labels: list[int]) -> DataFrame:
    """Dense form: a row for each actual label, a column for each predicted one."""
    return confusion_matrix(df, predicted, actual, labels).groupBy("actual").pivot("predicted", labels).agg(F.sum("n")).orderBy("actual")


def score_histogram(df: DataFrame, score: str, most: int = MAX_SCORE) -> DataFrame:
    """Count and percentage of every score from 0 to `most`, zeros included."""
    counts = df.groupBy(F.col(score).cast("bigint").alias("score")).count()
    total = df.agg(F.count(score).alias("total"))
    return df.sparkSession.range(most + 1).select(F.col("id").alias("score")).join(counts, "score", "left").crossJoin(F.broadcast(total)).select(
        F.col("score").cast("int").alias("score"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("n"),
        F.when(F.col("total") > 0, 100.0 * F.coalesce("count", F.lit(0)) / F.greatest("total", F.lit(1))).otherwise(0.0).alias("percent"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of the values that occur, by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    c = F.col(column)
    return df.groupBy(*by or []).agg(F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def error_frequency(df: DataFrame, errors: str = "errors") -> DataFrame:
    """How often each type of error occurs, most frequent first."""
    # a plain explode would make the optimizer filter by the size of the array, and compute the array's expressions again for it
    each = df.select(F.explode_outer(errors).alias("e")).where("e IS NOT NULL")
    return each.select(F.split("e", ":")[0].alias("error_type")).groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type")


def error_share(df: DataFrame, errors: str = "errors") -> DataFrame:
    some = F.size(errors) > 0
    return df.agg(F.count("*").alias("n"), F.count_if(some).alias("n_with_errors"), _share(some).alias("with_errors"), _share(~some).alias("without_errors"))


def confidence_split(df: DataFrame, confidence: str = "confidence", least: float = 0.85) -> DataFrame:
    c = F.col(confidence)
    return df.agg(F.count_if(c >= least).alias("n_high"), F.count_if(c < least).alias("n_low"), _share(c >= least).alias("high"), _share(c < least).alias("low"))


def top_disagreements(df: DataFrame, a: str, b: str, key: str, k: int = 10) -> DataFrame:
    """The k largest differences; ties by key."""
    return df.where(F.col(a) != F.col(b)).withColumn("diff", F.abs(F.col(a) - F.col(b))).orderBy(F.desc("diff"), key).limit(k)


def outliers(df: DataFrame, a: str, b: str, beyond: int = 2) -> DataFrame:
    return df.withColumn("diff", F.abs(F.col(a) - F.col(b))).where(F.col("diff") > beyond)


def report(df: DataFrame, auto: str, human: str, key: str, items: int = ITEMS, goal: float = 0.90) -> DataFrame:
    """One row: item_level, protocol_level and summary (goal reached, protocol accuracy)."""
    item = item_agreement(df, auto, human).select(F.struct("*").alias("item_level"))
    protocol = protocol_agreement(df, auto, human, key, items).select(F.struct("*").alias("protocol_level"))
    return item.crossJoin(protocol).withColumn("summary", F.struct((F.col("item_level.exact") >= goal).alias("meets_goal"), F.col("protocol_level.within_10_pts").alias("protocol_accuracy")))
