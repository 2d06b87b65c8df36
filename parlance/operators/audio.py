"""Waveforms as arrays: normalisation, framing, segmentation, trimming, filters; and spectral operators in Arrow batches.

The array operators are built-in higher-order functions of one row; a frame is
20 ms, of `frame` samples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import let
from parlance.operators.batches import BYTES, batched
from parlance.operators.naming import but, fresh
from parlance.session import bounded


@dataclass(frozen=True)
class Audio:
    """Fixed values of the preprocessor."""

    sample_rate: int = 16000
    min_silence_ms: int = 300
    frame_ms: int = 20
    silence_db: float = -40.0
    noise_db: float = -35.0
    target_rms: float = 0.1
    shortest: float = 0.5
    longest: float = 30.0

    @property
    def frame(self) -> int:
        return self.sample_rate * self.frame_ms // 1000

    @property
    def silence_frames(self) -> int:
        return self.min_silence_ms // self.frame_ms

    @property
    def threshold(self) -> float:
        return 10 ** (self.silence_db / 20)


def _squares(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def rms(w: Column) -> Column:
    return F.when(F.size(w) > 0, F.sqrt(_squares(w) / F.greatest(F.size(w), F.lit(1)))).otherwise(0.0)


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def normalized(w: Column, target: float = Audio.target_rms) -> Column:
    """Scaled to the target RMS where there is any signal, and held within -1 and 1."""
    gain = lambda loud: F.when(loud > 1e-8, target / F.greatest(loud, F.lit(1e-8))).otherwise(1.0)
    return let(gain(rms(w)), lambda g: F.transform(w, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * g))))


def frame_energies(w: Column, frame: int) -> Column:
    """RMS of each whole frame."""
    n = F.floor(F.size(w) / frame).cast("int")
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>")), lambda i: rms(F.slice(w, i * frame + 1, frame)))


def speech_frames(w: Column, frame: int, threshold: float) -> Column:
    """Numbers of the frames above the threshold."""
    flags = F.transform(frame_energies(w, frame), lambda e, i: F.when(e > threshold, i))
    return F.filter(flags, lambda i: i.isNotNull())


def islands(speech: Column, frames: Column, min_silence: int, short_end: bool = True) -> Column:
    """(start, end, tail) of the runs of speech frames, split where `min_silence` silent frames follow.

    A closed run ends before its last speech frame (`short_end`, the reference behaviour) or after it; a tail
    run, which the end of the audio cuts off, has `tail` set.
    """
    start = F.array().cast("array<struct<start:int,last:int>>")

    def step(a: Column, i: Column) -> Column:
        joined = (F.size(a) > 0) & (i - F.element_at(a, F.greatest(F.size(a), F.lit(1)))["last"] <= min_silence)
        kept = F.when(joined, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
        first = F.when(joined, F.get(a, F.size(a) - 1)["start"]).otherwise(i)
        return F.array_append(kept, F.struct(first.alias("start"), i.alias("last")))

    runs = F.aggregate(speech, start, step)
    return F.transform(runs, lambda x: F.struct(x["start"].alias("start"), (x["last"] + (0 if short_end else 1)).alias("end"), (frames - 1 - x["last"] < min_silence).alias("tail")))


def segments(df: DataFrame, waveform: str = "waveform", audio: Audio = Audio(), frame: int | None = None, min_silence: int | None = None, threshold: float | None = None, short_end: bool = True) -> DataFrame:
    """A row for each segment: `segment`, `start_time`, `end_time`, and its `waveform`; without speech, the whole audio."""
    frame, quiet = frame or audio.frame, audio.silence_frames if min_silence is None else min_silence
    level, rate, w = audio.threshold if threshold is None else threshold, float(audio.sample_rate), F.col(waveform)
    step = df.withColumn("_speech", speech_frames(w, frame, level)).withColumn("_frames", F.floor(F.size(w) / frame).cast("int"))
    found = step.withColumn("_runs", islands(F.col("_speech"), F.col("_frames"), quiet, short_end))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(True).alias("tail")))
    found = found.select("*", F.posexplode(F.when(F.size("_runs") > 0, F.col("_runs")).otherwise(whole)).alias("segment", "_run"))
    begin, end = F.col("_run.start") * frame, F.when(F.col("_run.tail"), F.size(w)).otherwise(F.col("_run.end") * frame)
    found = found.withColumn("_begin", begin).withColumn("_end", end)
    kept = [c for c in df.columns if c != waveform]
    return found.select(*kept, "segment", (F.col("_begin") / rate).alias("start_time"), (F.col("_end") / rate).alias("end_time"), F.slice(w, F.col("_begin") + 1, F.greatest(F.col("_end") - F.col("_begin"), F.lit(0))).alias(waveform))


def trimmed(df: DataFrame, waveform: str = "waveform", start_time: str = "start_time", end_time: str = "end_time", audio: Audio = Audio(), frame: int | None = None, threshold: float | None = None) -> DataFrame:
    """From the first to the last frame of speech; unchanged without speech. A partial last frame goes."""
    frame, level, rate, w = frame or audio.frame, audio.threshold if threshold is None else threshold, float(audio.sample_rate), F.col(waveform)
    step = df.withColumn("_speech", speech_frames(w, frame, level)).withColumn("_some", F.size("_speech") > 0)
    step = step.withColumn("_a", F.get("_speech", F.lit(0)) * frame).withColumn("_b", (F.array_max("_speech") + 1) * frame).withColumn("_t", F.col(start_time))
    step = step.withColumn(end_time, F.when(F.col("_some"), F.col("_t") + F.col("_b") / rate).otherwise(F.col(end_time)))
    step = step.withColumn(start_time, F.when(F.col("_some"), F.col("_t") + F.col("_a") / rate).otherwise(F.col(start_time)))
    return step.withColumn(waveform, F.when(F.col("_some"), F.slice(w, F.col("_a") + 1, F.col("_b") - F.col("_a"))).otherwise(w)).drop("_speech", "_some", "_a", "_b", "_t")


def usable_segments(df: DataFrame, waveform: str = "waveform", audio: Audio = Audio(), short_end: bool = True) -> DataFrame:
    """`usable(trimmed(segments(df)))` in one pass over the samples.

    Segments begin at whole frames, so that the frames of speech are found once for the recording, and segments, what
    is trimmed of them and their length follow from those; samples are only copied for the segments that stay.
    """
    w, frame, rate = F.col(waveform), audio.frame, float(audio.sample_rate)
    frames = F.floor(F.size(w) / frame).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(True).alias("tail")))

    def span(speech: Column, x: Column, k: Column) -> Column:
        begin, end = x["start"] * frame, F.when(x["tail"], F.size(w)).otherwise(x["end"] * frame)
        # whole frames of the segment alone count
        spoken = F.filter(speech, lambda i: (i >= x["start"]) & ((i + 1) * frame <= end))
        return let(F.array_max(spoken), lambda last: F.struct(k.alias("segment"), begin.alias("begin"), F.when(last.isNull(), F.greatest(end, begin)).otherwise((last + 1) * frame).alias("end")))

    def spans(speech: Column) -> Column:
        runs = F.when(F.size(speech) > 0, islands(speech, frames, audio.silence_frames, short_end)).otherwise(whole)
        return F.transform(runs, lambda x, k: span(speech, x, k))

    timed = F.transform(let(speech_frames(w, frame, audio.threshold), spans), lambda x: F.struct(x["segment"], x["begin"], x["end"], (x["begin"] / rate).alias("start_time"), (x["begin"] / rate + (x["end"] - x["begin"]) / rate).alias("end_time")))
    kept = F.filter(timed, lambda x: (x["end_time"] - x["start_time"]).between(audio.shortest, audio.longest))
    [part] = fresh(df.columns, "_part")
    found = df.select("*", F.explode(kept).alias(part))
    x = F.col(part)
    return found.select(*but(df, (waveform, "segment", "start_time", "end_time")), x["segment"].alias("segment"), x["start_time"].alias("start_time"), x["end_time"].alias("end_time"), F.slice(w, x["begin"] + 1, x["end"] - x["begin"]).alias(waveform))


def duration(start: str = "start_time", end: str = "end_time") -> Column:
    return F.col(end) - F.col(start)


def usable(df: DataFrame, audio: Audio = Audio(), start: str = "start_time", end: str = "end_time") -> DataFrame:
    return df.where(duration(start, end).between(audio.shortest, audio.longest))


def truncated(w: Column, audio: Audio = Audio()) -> Column:
    return F.slice(w, 1, int(audio.longest * audio.sample_rate))


def frame_segments(frames: DataFrame, by: list[str], order: str, speech: Column, min_silence: int, short_end: bool = True) -> DataFrame:
    """The same segmentation over frames that are rows: gaps and islands within each of `by`.

    Returns `start_frame`, `end_frame` (exclusive) and `tail` of each island, frames numbered from 0 by `order`.
    """
    rows = Window.partitionBy(*by)
    numbered = frames.select(*by, order, speech.alias("_s")).withColumn("_i", F.row_number().over(rows.orderBy(order)) - 1).withColumn("_n", F.count("*").over(rows))
    spoken = numbered.where("_s").withColumn("_before", F.lag("_i").over(rows.orderBy("_i")))
    opens = F.when(F.col("_before").isNull() | (F.col("_i") - F.col("_before") > min_silence), 1).otherwise(0)
    island = spoken.withColumn("_island", F.sum(opens).over(rows.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = island.groupBy(*by, "_island").agg(F.min("_i").alias("start_frame"), F.max("_i").alias("_last"), F.max("_n").alias("_n"))
    tail = F.col("_n") - 1 - F.col("_last") < min_silence
    return ends.select(*by, "start_frame", F.when(tail, F.col("_n")).otherwise(F.col("_last") + (0 if short_end else 1)).cast("bigint").alias("end_frame"), tail.alias("tail"))


#: Fixed values of the resampler: zero crossings of the kernel on each side, and its cutoff as a share of the lower Nyquist frequency.
CROSSINGS, ROLLOFF = 6, 0.99
#: Outputs of one matrix product.
OUTPUTS = 1 << 16


@lru_cache(maxsize=64)
def filter_bank(rate: int, to: int) -> tuple[np.ndarray, int]:
    """(weights, samples before the first one): column p has the weights of the samples around an output of phase p.

    Rates are in lowest terms: of `to` outputs, each has its own place between the samples, and the next `to` have the same
    places, `rate` samples later. The kernel is a sinc in a squared cosine (Hann) window.
    """
    base = min(rate, to) * ROLLOFF
    width = math.ceil(CROSSINGS * rate / base)
    at = np.arange(-width, width + rate)[:, None] / rate - np.arange(to) / to
    t = np.clip(at * base, -CROSSINGS, CROSSINGS)
    return np.sinc(t) * np.cos(np.pi * t / CROSSINGS / 2) ** 2 * (base / rate), width


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Band-limited resampling by a bank of windowed sinc filters, one for each phase, as products of blocks of the signal.

    Each output needs the 2 * CROSSINGS / ROLLOFF samples (of the lower rate) around it, so that any piece of a signal can be
    resampled with as many samples on its sides. Beyond its ends, the signal is zero.
    """
    if rate == to or not len(x):
        return x
    g = math.gcd(rate, to)
    rate, to = rate // g, to // g
    bank, width = filter_bank(rate, to)
    n = -(-len(x) * to // rate)
    steps = -(-n // to)
    padded = np.zeros((steps - 1) * rate + len(bank))
    inner = x[: len(padded) - width]
    padded[width : width + len(inner)] = inner
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(bank))[::rate]
    block = max(1, OUTPUTS // to)
    return np.concatenate([(windows[i : i + block] @ bank).ravel() for i in range(0, steps, block)])[:n]


def spectral_gate(x: np.ndarray, audio: Audio = Audio(), size: int = 512, hop: int = 128) -> np.ndarray:
    """Keep the bins above the noise profile of the first half second, by short-time Fourier transform and overlap-add."""
    if len(x) < size:
        return x
    window = np.hanning(size + 1)[:-1]
    padded = np.pad(x, size // 2, mode="reflect")
    count = 1 + (len(padded) - size) // hop
    at = np.arange(count)[:, None] * hop + np.arange(size)
    f = np.fft.rfft(padded[at] * window)
    noise = np.abs(f[: max(1, int(0.5 * audio.sample_rate) // hop)]).mean(0)
    f *= np.abs(f) > noise * 10 ** (audio.noise_db / 20)
    out, weight = np.zeros(len(padded)), np.zeros(len(padded))
    np.add.at(out, at, np.fft.irfft(f, size) * window)
    np.add.at(weight, at, np.broadcast_to(window**2, at.shape))
    return (out / np.where(weight > 1e-10, weight, 1))[size // 2 : size // 2 + len(x)]


def spectral(df: DataFrame, waveform: str = "waveform", sample_rate: str = "sample_rate", gate: bool = True, audio: Audio = Audio()) -> DataFrame:
    """Resample to the target rate and gate noise, in Arrow batches.

    Where `df` has a column `error`, a row that fails gets its message there and no samples, and other rows go
    on; so does one that has an error already.
    """
    bounded(df.sparkSession)
    return df.mapInPandas(partial(spectral_frames, waveform=waveform, sample_rate=sample_rate, gate=gate, audio=audio), df.schema)


def spectral_frames(batches: Iterator[pd.DataFrame], waveform: str = "waveform", sample_rate: str = "sample_rate", gate: bool = True, audio: Audio = Audio()) -> Iterator[pd.DataFrame]:
    """As `spectral`, of pandas frames, which it yields in bounded bytes."""
    for b in batches:
        isolated = "error" in b.columns
        errors = list(b["error"]) if isolated else [None] * len(b)
        out, begin, size = [], 0, 0
        for i, (w, rate) in enumerate(zip(b[waveform], b[sample_rate], strict=True)):
            x = np.zeros(0)
            try:
                if errors[i] is None:
                    x = resample(np.asarray(w, float), int(rate), audio.sample_rate)
                    x = spectral_gate(x, audio) if gate else x
            except Exception as e:  # noqa: BLE001  one file's failure is its own
                if not isolated:
                    raise
                errors[i] = str(e) or type(e).__name__
            out.append(x.astype(np.float32))
            size += out[-1].nbytes
            if size >= BYTES or i + 1 == len(b):
                yield b.iloc[begin : i + 1].assign(**{waveform: out, sample_rate: audio.sample_rate} | ({"error": errors[begin : i + 1]} if isolated else {}))
                out, begin, size = [], i + 1, 0


def _spans(x: np.ndarray, audio: Audio, short_end: bool = True) -> list[tuple[int, int]]:
    """(begin, end) of the trimmed segments of a scaled signal, as `usable_segments` has them before their length is judged."""
    frame, n = audio.frame, len(x) // audio.frame
    whole = x[: n * frame].reshape(n, frame)
    speech = np.flatnonzero(np.sqrt((whole * whole).mean(1)) > audio.threshold) if n else np.zeros(0, int)
    if not len(speech):
        return [(0, len(x))]
    out = []
    for run in np.split(speech, np.flatnonzero(np.diff(speech) > audio.silence_frames) + 1):
        start, last = int(run[0]), int(run[-1])
        end = len(x) if n - 1 - last < audio.silence_frames else (last + (not short_end)) * frame
        spoken = run[(run + 1) * frame <= end]
        out.append((start * frame, (int(spoken[-1]) + 1) * frame if len(spoken) else max(end, start * frame)))
    return out


#: Rows of `segment_frames` of decoded files.
SEGMENTS = "file string, sample_rate int, segment int, start_time double, end_time double, waveform array<float>"


def segment_frames(batches: Iterator[pd.DataFrame], audio: Audio = Audio(), gate: bool = True) -> Iterator[pd.DataFrame]:
    """SEGMENTS of decoded files (`file, waveform, sample_rate, error`), as `preprocess` has them, in one worker: only segments leave it."""
    rate = float(audio.sample_rate)

    def rows(b: pd.DataFrame) -> Iterator[tuple]:
        for file, x, error in zip(b["file"], b["waveform"], b["error"], strict=True):
            x = np.asarray(x, float)
            loud = math.sqrt((x * x).sum() / max(len(x), 1))
            x = np.clip(x * (audio.target_rms / loud if loud > 1e-8 else 1.0), -1, 1)
            for k, (begin, end) in enumerate(_spans(x, audio) if error is None else []):
                start, stop = begin / rate, begin / rate + (end - begin) / rate
                if audio.shortest <= stop - start <= audio.longest:
                    yield file, audio.sample_rate, k, start, stop, x[begin:end].astype(np.float32)

    for b in spectral_frames(batches, gate=gate, audio=audio):
        yield from batched(rows(b), SEGMENTS)


def preprocess(df: DataFrame, audio: Audio = Audio(), gate: bool = True) -> DataFrame:
    """waveform, sample_rate -> resampled, gated, normalised, segmented, trimmed segments of usable length."""
    clean = spectral(df, gate=gate, audio=audio).withColumn("waveform", normalized(F.col("waveform"), audio.target_rms))
    return usable_segments(clean, audio=audio)
