"""The preprocessor over recordings of any length, whose blocks are rows (`sources/wav.py`).

Resampling and the spectral gate need no more than the samples around them, which come with each block. What belongs to a whole recording
goes between rows as a few numbers: the noise profile of its first half second, the sum of its squares, the numbers of its frames of
speech. Segments take their samples from the blocks that they lie in. So no row is larger than a block or a segment, and the result is that
of `audio.preprocess` on the whole signal, up to rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.audio import Audio, filter_bank
from parlance.operators.batches import batched, kept
from parlance.session import bounded

SIZE, HOP = 512, 128
_WINDOW = np.hanning(SIZE + 1)[:-1]


def resample_part(x: np.ndarray, lo: int, first: int, end: int, rate: int, to: int) -> np.ndarray:
    """Outputs `first` to `end` of the whole signal's resampling, from its samples from `lo` on; the signal is zero where x has none."""
    g = math.gcd(rate, to)
    rate, to = rate // g, to // g
    if rate == to:
        return x[first - lo : end - lo].astype(float)
    bank, width = filter_bank(rate, to)
    a, z = first // to, (end - 1) // to + 1
    padded = np.zeros((z - a - 1) * rate + len(bank))
    begin = a * rate - width
    i, j = max(lo, begin), min(lo + len(x), begin + len(padded))
    if i < j:
        padded[i - begin : j - begin] = x[i - lo : j - lo]
    out = (np.lib.stride_tricks.sliding_window_view(padded, len(bank))[::rate] @ bank).ravel()
    return out[first - a * to : end - a * to]


def _frames(x: np.ndarray, lo: int, n: int, k0: int, k1: int) -> np.ndarray:
    """Spectra of the windows k0 to k1 of a signal of n samples, whose ends are mirrored."""
    at = np.arange(k1 - k0)[:, None] * HOP + np.arange(SIZE)
    i = np.abs(at + k0 * HOP - SIZE // 2)
    i = np.where(i >= n, 2 * (n - 1) - i, i)
    return np.fft.rfft(x[i - lo] * _WINDOW)


def _overlapped(parts: np.ndarray) -> np.ndarray:
    """Sum of windows, each HOP samples behind the one before."""
    parts, each = parts.reshape(len(parts), -1, HOP), SIZE // HOP
    out = np.zeros((len(parts) + each - 1, HOP))
    for j in reversed(range(each)):
        out[j : j + len(parts)] += parts[:, j]
    return out.ravel()


def noise(x: np.ndarray, lo: int, n: int, audio: Audio) -> np.ndarray:
    """Mean magnitudes of the windows of the first half second."""
    return np.abs(_frames(x, lo, n, 0, min(1 + n // HOP, max(1, int(0.5 * audio.sample_rate) // HOP)))).mean(0)


def gate_part(x: np.ndarray, lo: int, a: int, z: int, n: int, profile: np.ndarray, audio: Audio) -> np.ndarray:
    """Samples a to z of the gated signal, from its samples from `lo` on, SIZE more on each side where there are any."""
    k0, k1 = max(0, -(-(a - SIZE // 2 + 1) // HOP)), min(n // HOP, (z - 1 + SIZE // 2) // HOP) + 1
    f = _frames(x, lo, n, k0, k1)
    f *= np.abs(f) > profile * 10 ** (audio.noise_db / 20)
    out, weight = _overlapped(np.fft.irfft(f, SIZE) * _WINDOW), _overlapped(np.broadcast_to(_WINDOW**2, (k1 - k0, SIZE)))
    begin = k0 * HOP - SIZE // 2
    return (out / np.where(weight > 1e-10, weight, 1))[a - begin : z - begin]


def _span(row, audio: Audio) -> tuple[np.ndarray, int, int, int, int]:
    """(resampled samples, number of the first, block's first, block's end, signal's length), all at the target rate."""
    rate, to = int(row.sample_rate), audio.sample_rate
    n = -(-int(row.n_frames) * to // rate)
    a = int(row.start) * to // rate
    z = min(n, -(-(int(row.start) + int(row.length)) * to // rate))
    lo, hi = max(0, a - SIZE), min(n, z + SIZE)
    return resample_part(np.asarray(row.waveform), int(row.start) - int(row.lead), lo, hi, rate, to) if hi > lo else np.zeros(0), lo, a, z, n


#: What a pass over the samples leaves of a block: its first sample's number, the length of the signal, the sum of its squares, the RMS of its
#: frames. The first block of a recording also has the samples of a block, and the noise profile if there are more blocks.
MEASURED = "path string, block long, first long, n long, long long, squares double, frames array<double>, profile array<double>"
#: Blocks whose numbers are in a row group.
SMALL = 256


def _gated(row, audio: Audio, gate: bool) -> tuple[np.ndarray, int, int, np.ndarray | None]:
    """(resampled and gated samples of a block, number of the first, signal's length, noise profile). The first block has its recording's profile in it."""
    x, lo, a, z, n = _span(row, audio)
    if not gate or n < SIZE:
        return x[a - lo : z - lo].astype(np.float32), a, n, None
    profile = noise(x, lo, n, audio) if row.block == 0 else np.asarray(row.profile)
    y = gate_part(x, lo, a, z, n, profile, audio) if z > a else x[a - lo : z - lo]
    return y.astype(np.float32), a, n, profile


def _scaled(x: np.ndarray, gain: float) -> np.ndarray:
    return np.clip(x.astype(float) * gain, -1, 1).astype(np.float32)


def _loudness(x: np.ndarray, frame: int) -> np.ndarray:
    """RMS of each whole frame."""
    x = x[: len(x) // frame * frame].astype(float).reshape(-1, frame)
    return np.sqrt((x * x).mean(1))


def measured(blocks: DataFrame, audio: Audio = Audio(), gate: bool = True) -> DataFrame:
    """MEASURED rows of blocks that are resampled and gated for it, written to the shared folder: numbers only, no samples.

    Blocks have whole seconds, so that they begin at whole samples and frames of any rate.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(r) -> tuple:
            y, a, n, profile = _gated(r, audio, gate)
            more = r.block == 0 and r.length < r.n_frames
            long = None if r.block else int(r.length) * audio.sample_rate // int(r.sample_rate) if more else 1 << 62
            return r.path, r.block, a, n, long, float((y.astype(float) ** 2).sum()), _loudness(y, audio.frame), profile if more else None

        for b in batches:
            for out in batched(map(row, b.itertuples()), MEASURED):
                yield out.astype({"long": "Int64"})

    good = blocks.where("error IS NULL")
    # the first block of a recording has its first half second: blocks are a second long at least
    first = kept(good.where("block = 0").mapInPandas(measure, MEASURED), SMALL)
    later = kept(good.where("block > 0").join(first.select("path", "profile"), "path").mapInPandas(measure, MEASURED), SMALL)
    return first.unionByName(later)


def gains(numbers: DataFrame, audio: Audio = Audio()) -> DataFrame:
    """`path, n, long, gain` of each recording: what scales it to the target RMS."""
    found = numbers.groupBy("path").agg(F.max("n").alias("n"), F.max("long").alias("long"), F.sqrt(F.sum("squares") / F.greatest(F.max("n"), F.lit(1))).alias("loud"))
    gain = F.when(F.col("loud") > 1e-8, audio.target_rms / F.greatest("loud", F.lit(1e-8))).otherwise(1.0)
    return found.select("path", "n", "long", gain.alias("gain"))


def speech(blocks: DataFrame, numbers: DataFrame, scale: DataFrame, audio: Audio = Audio(), gate: bool = True) -> DataFrame:
    """`path, n, i`: numbers of the frames of speech of scaled recordings."""
    frame = audio.frame
    loud = numbers.select("path", "first", "frames").join(scale.select("path", "n", "gain"), "path")
    rms = F.col("rms") * F.col("gain")
    if audio.threshold * math.sqrt(frame) >= 1:
        # else a frame with a sample beyond 1 is above the threshold, held within 1 or not; here it must be seen

        def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def row(r) -> tuple:
                y, a, _, _ = _gated(r, audio, gate)
                return r.path, a, r.n, _loudness(_scaled(y, r.gain), frame)

            for b in batches:
                yield from batched(map(row, b.itertuples()), "path, first, n, frames")

        profiles = numbers.where("block = 0").select("path", "profile").join(scale.select("path", "n", "gain"), "path")
        loud = blocks.where("error IS NULL").join(profiles, "path").mapInPandas(held, "path string, first long, n long, frames array<double>")
        rms = F.col("rms")
    found = loud.select("*", F.posexplode("frames").alias("k", "rms")).where(rms > audio.threshold)
    return found.select("path", "n", (F.col("first") / frame + F.col("k")).cast("long").alias("i"))


def spans(spoken: DataFrame, files: DataFrame, audio: Audio = Audio(), short_end: bool = True) -> DataFrame:
    """`path, segment, begin, end` (samples) of the trimmed segments of usable length, by gaps and islands over frames that are rows.

    `spoken` has `path, n, i` of the frames of speech, `files` has `path, n`.
    """
    frame, quiet, rate = audio.frame, audio.silence_frames, float(audio.sample_rate)
    rows = Window.partitionBy("path").orderBy("i")
    spoken = spoken.withColumn("gap", F.col("i") - F.lag("i").over(rows))
    island = spoken.withColumn("segment", F.sum(F.when(F.col("gap") <= quiet, 0).otherwise(1)).over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    # the last frame of speech, and the one before it, within an island
    ends = island.groupBy("path", "segment").agg(F.min("i").alias("start"), F.max("i").alias("last"), F.max(F.when(F.col("gap") <= quiet, F.col("i") - F.col("gap"))).alias("before"), F.max("n").alias("n"))
    tail = F.floor(F.col("n") / frame) - 1 - F.col("last") < quiet
    # a closed island loses its last frame; what is left ends with the frame of speech before, if there is one
    end = F.when(tail | F.lit(not short_end), (F.col("last") + 1) * frame).otherwise(F.coalesce((F.col("before") + 1) * frame, F.col("start") * frame))
    found = ends.select("path", F.col("segment").cast("int").alias("segment"), (F.col("start") * frame).alias("begin"), end.alias("end"))
    silent = files.join(spoken.select("path").distinct(), "path", "left_anti").select("path", F.lit(0).alias("segment"), F.lit(0).cast("long").alias("begin"), F.col("n").alias("end"))
    duration = (F.col("begin") / rate + (F.col("end") - F.col("begin")) / rate) - F.col("begin") / rate
    return found.unionByName(silent).where(duration.between(audio.shortest, audio.longest))


PIECE = "path string, segment int, begin long, end long, block long, x array<float>"


def pieces(blocks: DataFrame, wanted: DataFrame, audio: Audio = Audio(), gate: bool = True) -> DataFrame:
    """PIECE rows: the samples that the segments `wanted` (`path, block, segment, begin, end, gain, profile`) have in each of their blocks."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(b: pd.DataFrame) -> Iterator[tuple]:
            for r in b.itertuples():
                y, first, _, _ = _gated(r, audio, gate)
                y = _scaled(y, r.gain)
                for x in r.parts:
                    a, z = max(x["begin"], first), min(x["end"], first + len(y))
                    yield r.path, x["segment"], x["begin"], x["end"], r.block, y[a - first : max(a, z) - first]

        for b in batches:
            yield from batched(rows(b), PIECE)

    parts = F.collect_list(F.struct("segment", "begin", "end")).alias("parts")
    by_block = wanted.groupBy("path", "block").agg(parts, F.first("gain").alias("gain"), F.first("profile").alias("profile"))
    return blocks.where("error IS NULL").join(by_block, ["path", "block"]).mapInPandas(cut, PIECE)


def segments(blocks: DataFrame, audio: Audio = Audio(), gate: bool = True, short_end: bool = True) -> DataFrame:
    """`file, path, segment, start_time, end_time, sample_rate, waveform` of the usable segments of every recording.

    `blocks` should be written before (`batches.write_large`), or cheap to read three times. A first pass leaves numbers of each block in the shared
    folder, from which the segments follow; the samples of those are made by a second one, and meet only where a segment lies in two blocks or more.
    """
    rate = float(audio.sample_rate)
    bounded(blocks.sparkSession)
    numbers = measured(blocks, audio, gate)
    scale = kept(gains(numbers, audio), 1 << 16)
    found = kept(spans(speech(blocks, numbers, scale, audio, gate), scale.select("path", "n"), audio, short_end), 1 << 16)
    # blocks have the same number of samples, so that a sample's block is known
    first, last = F.expr("begin DIV long"), F.expr("(end - 1) DIV long")
    profiles = numbers.where("block = 0").select("path", "profile")
    found = found.join(scale.select("path", "long", "gain"), "path").join(profiles, "path")
    wanted = lambda df: df.select("path", "segment", "begin", "end", "gain", "profile", F.explode(F.sequence(first, last)).alias("block"))
    columns = ["path", "segment", "begin", "end"]
    within = pieces(blocks, wanted(found.where(first == last)), audio, gate).select(*columns, F.col("x").alias("waveform"))
    across = pieces(blocks, wanted(found.where(first != last)), audio, gate).groupBy(*columns).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "x"))), lambda p: p["x"])).alias("waveform"))
    begin, end = F.col("begin") / rate, F.col("begin") / rate + (F.col("end") - F.col("begin")) / rate
    return within.union(across).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "path", "segment", begin.alias("start_time"), end.alias("end_time"), F.lit(audio.sample_rate).alias("sample_rate"), "waveform")
