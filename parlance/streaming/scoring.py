"""Scoring and agreement over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import agreement, ensemble


def pair_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def score_stream(pairs: DataFrame, use_ensemble: bool = False) -> DataFrame:
    """Scores of a stream of pairs: a projection without state."""
    return ensemble.score_pairs(pairs, use_ensemble)


def windowed_agreement(scores: DataFrame, auto: str, human: str, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Item agreement in tumbling windows; rows later than `late` are left out and their windows' state is dropped."""
    timed = scores.withWatermark(time, late).withColumn("window", F.window(time, window))
    return agreement.item_agreement(timed, auto, human, by=["window", *(by or [])])
