"""Transcripts: clean-up, merging of segments, joining with a manifest, and the seam for a recogniser.

No model is part of this library. A caller brings `load`, a function that a worker calls once and that returns
`recognise(waveforms, sample_rates)`: for a list of waveforms of like length, a (text, log_probs) each, where log_probs are
the log-probabilities of the text's tokens, or None where the recogniser has no scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators.naming import but, fresh


def postprocess(df: DataFrame, column: str = "transcription", **switches) -> DataFrame:
    return df.withColumn(column, text.postprocessed(F.col(column), **switches))


def merge_segments(df: DataFrame, by: list[str], start: str, said: str, confidence: str, files: DataFrame | None = None) -> DataFrame:
    """`transcription` and mean `confidence` of each file; empty segments add nothing to the text.

    A segment without confidence has no part in the mean; a file of only such segments has none. With `files`, a row for each
    of them: one without segments has the empty text and confidence 0.
    """
    order = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.coalesce(F.col(said), F.lit("")).alias("t"))))
    parts = F.filter(F.transform(order, lambda x: x["t"]), lambda t: t != "")
    merged = df.groupBy(*by).agg(F.array_join(parts, " ").alias("transcription"), F.avg(confidence).alias("confidence"))
    if files is None:
        return merged
    found = files.select(*by).distinct().join(merged, by, "left")
    none = F.col("transcription").isNull()
    return found.select(*by, F.coalesce("transcription", F.lit("")).alias("transcription"), F.when(none, 0.0).otherwise(F.col("confidence")).alias("confidence"))


def mean_log_prob(tokens: str):
    """Mean of an array of token log-probabilities; 0 without tokens."""
    return F.when(F.size(tokens) > 0, F.aggregate(tokens, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(tokens), F.lit(1))).otherwise(0.0)


def with_references(transcripts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Join `file` with the manifest's `audio` (its name without folders) and `reference`."""
    name = F.regexp_extract("audio", r"[^/\\]*$", 0)
    return transcripts.join(manifest.select(name.alias("file"), "reference"), "file")


#: Confidence of a text whose recogniser has no scores.
UNSCORED = -1.0
#: Waveforms that a recogniser gets at a time.
BATCH = 16
RESULT = "text string, log_probs array<double>, error string"
Recognise = Callable[[list[np.ndarray], list[int]], list[tuple[str, list[float] | None]]]

_MODELS: dict[str, Recognise] = {}


def _model(load: Callable[[], Recognise]) -> Recognise:
    """The loaded recogniser: once in a worker's life, which Spark keeps for further tasks."""
    name = f"{load.__module__}.{load.__qualname__}"
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def buckets(lengths: list[int], most: int) -> list[list[int]]:
    """Numbers of the waveforms in batches of at most `most`, the longest of each less than twice the shortest, so that padding costs little."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if out and len(out[-1]) < most and lengths[i].bit_length() == lengths[out[-1][0]].bit_length():
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _recognised(recognise: Recognise, waves: list[np.ndarray | None], rates: list[int | None], most: int) -> list[tuple]:
    """(text, log_probs, error) of each waveform. Where a batch fails, its waveforms are tried alone; one that fails then has an error and no text."""
    out: list[tuple] = [(None, None, "no waveform")] * len(waves)

    def tried(some: list[int]) -> None:
        try:
            said = recognise([np.asarray(waves[i], np.float32) for i in some], [int(rates[i]) for i in some])
            if len(said) != len(some):
                raise ValueError(f"{len(said)} texts of {len(some)} waveforms")
        except Exception as e:  # noqa: BLE001  one segment's failure is its own
            if len(some) > 1:
                for i in some:
                    tried([i])
            else:
                out[some[0]] = (None, None, str(e) or type(e).__name__)
        else:
            for i, (text_, log_probs) in zip(some, said, strict=True):
                out[i] = (text_, None if log_probs is None else [float(p) for p in log_probs], None)

    known = [i for i, (w, r) in enumerate(zip(waves, rates, strict=True)) if w is not None and r is not None and r == r]
    for some in buckets([len(waves[i]) for i in known], most):
        tried([known[i] for i in some])
    return out


def confidence_of(log_probs: Column) -> Column:
    """Mean log-probability of the tokens; UNSCORED without scores, and 0 of no tokens."""
    total = F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + x)
    return F.when(log_probs.isNull(), UNSCORED).when(F.size(log_probs) == 0, 0.0).otherwise(total / F.size(log_probs))


def transcribe(segments: DataFrame, load: Callable[[], Recognise], batch: int = BATCH) -> DataFrame:
    """Add `transcription`, `log_probs`, `confidence` and `error` to segments (`waveform, sample_rate`).

    A segment whose recognition fails has its error, and neither text nor confidence; the others go on. A failing `load` ends the job.
    """

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        recognise = _model(load)
        for waves, rates in batches:
            yield pd.DataFrame(_recognised(recognise, list(waves), list(rates), batch), columns=["text", "log_probs", "error"], dtype=object)

    added = ("transcription", "log_probs", "confidence", "error")
    [said] = fresh(segments.columns, "_said")
    # its result is used four times; so named, no part of the plan calls it again
    step = segments.withColumn(said, run.asNondeterministic()(F.col("waveform"), F.col("sample_rate")))
    x = F.col(said)
    return step.select(*but(segments, added), x["text"].alias("transcription"), x["log_probs"].alias("log_probs"), F.when(x["error"].isNull(), confidence_of(x["log_probs"])).alias("confidence"), x["error"].alias("error"))
