"""Tables of pairs, ratings and frames, derived from whole input tables.

No table has a hypothesis or a rating, so both follow from keys by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.session import ship


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conv_id, turn, role, pair_id, hypothesis, reference`: every turn's whole text, and the same with words left out, replaced and added."""
    turns = ship(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("reference"))
    key = F.col("conv_id") * 64 + F.col("turn")
    turns = turns.withColumn("pair_id", key).withColumn("_t", text.tokens(F.col("reference")))
    k = F.col("pair_id")
    said = F.filter(F.transform("_t", lambda x, i: F.when((k * 7 + (i + 1) * 3) % (2 + k % 6) == 0, None).when((k + i + 1) % 11 == 0, F.lit("este")).otherwise(x)), lambda x: x.isNotNull())
    said = F.when(k % 4 == 0, F.concat(said, F.array(F.lit("mercado")))).otherwise(said)
    return turns.select("conv_id", "turn", "role", "pair_id", F.when(k % 13 == 0, "  ").otherwise(F.array_join(said, " ")).alias("hypothesis"), "reference")


PAIRS_SQL = """
turns AS (SELECT conv_id, turn, role, conv_id * 64 + turn AS pair_id, coalesce(text, '') AS reference FROM conversations),
split AS (SELECT *, list_filter(regexp_split_to_array(reference, '\\s+'), lambda x: x <> '') AS t FROM turns),
said AS (SELECT *, list_filter([CASE WHEN (pair_id * 7 + i * 3) % (2 + pair_id % 6) = 0 THEN NULL WHEN (pair_id + i) % 11 = 0 THEN 'este' ELSE t[i] END FOR i IN range(1, len(t) + 1)], lambda x: x IS NOT NULL) AS s FROM split),
pairs AS (SELECT conv_id, turn, role, pair_id, reference, CASE WHEN pair_id % 13 = 0 THEN '  ' ELSE array_to_string(CASE WHEN pair_id % 4 = 0 THEN list_append(s, 'mercado') ELSE s END, ' ') END AS hypothesis FROM said)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`event_id, user_id, auto, human`: a rating of 0 to 6 for every event, and a second one that differs by at most 3."""
    e = F.col("event_id")
    auto = (e * 5 + F.coalesce("user_id", F.lit(0))) % 7
    off = F.when(e % 10 == 0, 1).when(e % 10 == 5, -1).when(e % 97 == 0, 3).otherwise(0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", auto.alias("auto"), F.least(F.lit(6), F.greatest(F.lit(0), auto + off)).alias("human"))


RATINGS_SQL = """
base AS (SELECT event_id, user_id, (event_id * 5 + coalesce(user_id, 0)) % 7 AS auto FROM events),
ratings AS (SELECT event_id, user_id, auto, least(6, greatest(0, auto + CASE WHEN event_id % 10 = 0 THEN 1 WHEN event_id % 10 = 5 THEN -1 WHEN event_id % 97 = 0 THEN 3 ELSE 0 END)) AS human FROM base)"""
