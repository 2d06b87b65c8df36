"""Audio files derived from the vectors of `embeddings`, and a recogniser that knows nothing but lengths.

Each vector is repeated as a sound of 16 kHz; every third one stays alone, and others are followed by half a second of silence and a
second sound, which is long or too short to be kept. A frame is 20 ms, of 320 samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.batches import batched
from parlance.session import bounded
from parlance.sources import files

FRAME, RATE, SILENCE, SHORT = 320, 16000, 25, 15
#: Frames of a segment that the recogniser fails on.
BAD = 33


def sound(vec_id: int, vector: np.ndarray) -> np.ndarray:
    frames = [30 + vec_id % 5] + [[], [30 + vec_id % 4], [SHORT]][vec_id % 3]
    loud = 0.5 * vector / max(np.abs(vector).max(initial=0), 1e-9)
    parts = [np.resize(loud, n * FRAME) for n in frames]
    return np.concatenate([parts[0], *(y for x in parts[1:] for y in (np.zeros(SILENCE * FRAME), x))])


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`file, content`: a WAV file for each vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # a file is 160 times as large as its vector
            rows = ((f"{i:06d}.wav", files.encode_wav(sound(i, np.asarray(v, float)), RATE)) for i, v in zip(b["vec_id"], b["embedding"], strict=True))
            yield from batched(rows, "file, content")

    vectors = bounded(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").where(F.size("embedding") > 0)
    return vectors.mapInPandas(run, "file string, content binary")


def load():
    """A recogniser that says how many frames it heard, without scores of every fourth length."""

    def recognise(waves: list[np.ndarray], rates: list[int]) -> list[tuple[str, list[float] | None]]:
        out = []
        for w in waves:
            n = len(w) // FRAME
            if n == BAD:
                raise ValueError(f"{BAD} frames")
            out.append((f"uh, tramo {n}", None if n % 4 == 0 else [-(n % 7) / 8 - i / 16 for i in range(1 + n % 3)]))
        return out

    return recognise


#: DuckDB SQL: the segments' frames are known from the ids; closed ones end before their last frame.
ORACLE = f"""
WITH s AS (
  SELECT vec_id, k, n FROM (
    SELECT vec_id, generate_subscripts(n, 1) AS k, unnest(n) AS n FROM (
      SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN [30 + vec_id % 5] WHEN 1 THEN [29 + vec_id % 5, 30 + vec_id % 4] ELSE [29 + vec_id % 5] END AS n FROM embeddings WHERE len(embedding) > 0))),
c AS (SELECT *, CASE WHEN n % 4 = 0 THEN -1::DOUBLE ELSE -(n % 7) / 8.0::DOUBLE - (n % 3) / 32.0::DOUBLE END AS c FROM s)
SELECT printf('%06d.wav', vec_id) AS file, coalesce(string_agg('tramo ' || n, ' ' ORDER BY k) FILTER (n <> {BAD}), '') AS transcription, round(avg(c) FILTER (n <> {BAD}), 6) AS confidence
FROM c GROUP BY vec_id
"""

#: DuckDB SQL of the segments themselves: places in frames.
SEGMENTS = f"""
WITH s AS (
  SELECT vec_id, unnest(CASE vec_id % 3 WHEN 1 THEN [0, 1] ELSE [0] END) AS segment, 30 + vec_id % 5 AS long FROM embeddings WHERE len(embedding) > 0),
p AS (
  SELECT vec_id, segment, CASE segment WHEN 0 THEN 0 ELSE long + {SILENCE} END AS a, CASE WHEN segment = 1 THEN 30 + vec_id % 4 WHEN vec_id % 3 = 0 THEN long ELSE long - 1 END AS n FROM s)
SELECT printf('%06d.wav', vec_id) AS file, segment, round(a / 50.0::DOUBLE, 6) AS start_time, round((a + n) / 50.0::DOUBLE, 6) AS end_time, n AS frames FROM p
"""
