"""Audio operators over whole recordings: the fused segmentation, resampling, and the recogniser's seam."""

import math
import random
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance import cli
from parlance.operators import audio, batches, transcripts
from parlance.sources import files

RATE = 16000


def made_sound(r: random.Random) -> list[float]:
    """Loud and silent stretches that begin and end anywhere."""
    out: list[float] = []
    for _ in range(r.randint(0, 9)):
        level = r.choice((0.0, 0.0, 0.5))
        out += [level * r.choice((1, -1)) for _ in range(r.randint(1, 14_000))]
    return out


def test_segments_in_one_pass(spark):
    r = random.Random(1)
    rows = [(i, made_sound(r), "x", 5) for i in range(40)] + [(100, [], "x", 5), (101, [0.5] * 100, "x", 5), (102, [0.0] * 9000, "x", 5)]
    df = spark.createDataFrame(rows, "i int, waveform array<float>, note string, segment int")
    for short_end in (True, False):
        one = audio.usable_segments(df, short_end=short_end)
        three = audio.usable(audio.trimmed(audio.segments(df.drop("segment"), short_end=short_end)))
        got, wanted = ([sorted((x.i, x.segment, round(x.start_time, 9), round(x.end_time, 9), x.note, x.waveform) for x in d.collect()) for d in (one, three)])
        assert got == wanted and len(got) > 20


def convolved(x, rate, to):
    """The definition, sample by sample."""
    g = math.gcd(rate, to)
    rate, to = rate // g, to // g
    base = min(rate, to) * 0.99
    out = []
    for m in range(-(-len(x) * to // rate)):
        y = 0.0
        for k, v in enumerate(x):
            t = (k / rate - m / to) * base
            if abs(t) < 6:
                y += v * (math.sin(math.pi * t) / (math.pi * t) if t else 1.0) * math.cos(math.pi * t / 12) ** 2 * base / rate
        out.append(y)
    return out


@pytest.mark.parametrize(("rate", "to"), [(16000, 24000), (44100, 16000), (8000, 16000), (48000, 16000), (16000, 16000), (22050, 16000)])
def test_resampling(rate, to):
    r = np.random.default_rng(rate)
    for n in (0, 1, 7, 300):
        x = r.normal(size=n)
        got = audio.resample(x, rate, to)
        assert len(got) == (-(-n * to // rate)) and np.allclose(got, x if rate == to else convolved(x.tolist(), rate, to), atol=1e-12)


def test_resampling_in_blocks(monkeypatch):
    """A long signal, in few or many matrix products; a tone keeps its height and frequency."""
    t = np.arange(44100 * 2) / 44100
    x = np.sin(2 * np.pi * 440 * t)
    whole = audio.resample(x, 44100, 16000)
    monkeypatch.setattr(audio, "OUTPUTS", 1000)
    assert np.allclose(audio.resample(x, 44100, 16000), whole, atol=1e-12)
    inner = slice(100, -100)
    assert np.abs(whole - np.sin(2 * np.pi * 440 * np.arange(len(whole)) / 16000))[inner].max() < 2e-3


def load_counting():
    """Says lengths; fails on batches with an odd length in them, and on a length of 5 alone."""

    def recognise(waves, rates):
        assert len(waves) <= 4 and max(map(len, waves)) < 2 * max(1, min(map(len, waves)))
        if len(waves) > 1 and any(len(w) % 2 for w in waves) or [len(w) for w in waves] == [5]:
            raise RuntimeError("odd")
        return [(f"w{len(w)} at {r}", None if len(w) == 4 else [-len(w) / 8, 0.0][: len(w)]) for w, r in zip(waves, rates, strict=True)]

    return recognise


def load_short():
    return lambda waves, rates: []


def test_transcribe(spark):
    rows = [(i, [0.5] * (i % 9), RATE, f"note {i}", "mine") for i in range(60)] + [(100, None, RATE, "n", "mine"), (101, [0.5], None, "n", "mine")]
    df = spark.createDataFrame(rows, "i int, waveform array<float>, sample_rate int, transcription string, _said string").repartition(3)
    got = {r.i: r for r in transcripts.transcribe(df, load_counting, batch=4).collect()}
    assert len(got) == 62 and all(r._said == "mine" for r in got.values())
    for i in range(60):
        r, n = got[i], i % 9
        if n == 5:
            assert (r.transcription, r.log_probs, r.confidence, r.error) == (None, None, None, "odd")
        else:
            assert r.transcription == f"w{n} at {RATE}" and r.error is None
            assert r.confidence == (-1.0 if n == 4 else 0.0 if n == 0 else -0.125 if n == 1 else -n / 16)
    assert {got[100].error, got[101].error} == {"no waveform"} and got[100].confidence is None
    assert {r.error for r in transcripts.transcribe(df.where("i < 3"), load_short).collect()} == {"0 texts of 1 waveforms"}
    assert transcripts.transcribe(df.limit(0), load_counting).count() == 0


def test_recogniser_runs_once_a_segment(spark):
    df = spark.createDataFrame([(0, [0.5] * 4, RATE)], "i int, waveform array<float>, sample_rate int")
    plan = transcripts.transcribe(df, load_counting).where("error IS NULL AND confidence < 5")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_buckets():
    assert transcripts.buckets([], 4) == [] and transcripts.buckets([3, 100, 2, 90, 3, 2, 2], 3) == [[2, 5, 6], [0, 4], [3, 1]]


def load_lengths():
    return lambda waves, rates: [(f"Um, {len(w)}", [-0.5, -1.0]) for w in waves]


def test_transcribe_command(spark, tmp_path):
    """Folder to CSV: names in order, other files left out, a broken file and a silent one with what is known of them."""
    sound = tmp_path / "sound"
    sound.mkdir()
    tone = np.sin(np.arange(16000) / 20) / 2
    (sound / "b.wav").write_bytes(files.encode_wav(np.concatenate([tone, np.zeros(8000), tone]), RATE))
    (sound / "a.wav").write_bytes(files.encode_wav(np.stack([tone[::2], tone[::2]], 1), RATE // 2))
    (sound / "short.wav").write_bytes(files.encode_wav(tone[:1000], RATE))
    (sound / "broken.wav").write_bytes(b"RIFF")
    (sound / "notes.txt").write_text("-")
    with wave.open(str(sound / "none.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes(b"")
    cli.main(["transcribe", "--audio-dir", str(sound), "--output-csv", str(tmp_path / "out"), "--recogniser", f"{__name__}:load_lengths"], spark)
    back = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "out"), "file string, transcription string, confidence double").collect()]
    assert back == [("a.wav", "16000", -0.75), ("b.wav", "15680 16000", -0.75), ("broken.wav", "", None), ("none.wav", "", 0.0), ("short.wav", "", 0.0)]


def test_merge_without_confidence(spark):
    parts = spark.createDataFrame([("a", 1.0, "x", None), ("a", 2.0, "y", -1.0), ("b", 1.0, None, None)], "file string, s double, t string, c double")
    all_files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    got = sorted(map(tuple, transcripts.merge_segments(parts, ["file"], "s", "t", "c", all_files).collect()))
    assert got == [("a", "x y", -1.0), ("b", "", None), ("c", "", 0.0)]
    assert parts.select(transcripts.confidence_of(F.array()).alias("c")).first().c == 0.0


def test_batches_of_few_bytes(spark):
    """what is decoded, resampled and gated comes in batches of bounded bytes, whatever the batches that were read; so do those that workers get."""
    sound = np.sin(np.arange(16000) / 9) / 2
    wavs = pd.DataFrame({"file": [f"{i}.wav" for i in range(150)], "content": [files.encode_wav(sound, 8000)] * 150})
    decoded = list(files._decode(iter([wavs]), {"wav": files.decode_wav}))
    assert sum(map(len, decoded)) == 150 and max(map(len, decoded)) * sound.size * 4 <= batches.BYTES + sound.size * 4
    clean = list(audio.spectral_frames(iter([pd.concat(decoded, ignore_index=True)])))
    assert [f for b in clean for f in b["file"]] == list(wavs["file"]) and max(map(len, clean)) * sound.size * 8 <= batches.BYTES + sound.size * 8
    assert {len(w) for b in clean for w in b["waveform"]} == {32000} and all(e is None for b in clean for e in b["error"])
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    files.decoded(spark.createDataFrame(wavs.head(1)))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 8 << 20


def test_segments_in_one_worker(spark):
    """segments that are cut where files are decoded equal those of the built-in functions."""
    r = random.Random(11)
    wavs = [(f"{i}.wav", bytearray(files.encode_wav(np.array(made_sound(r) or [0.0]), RATE))) for i in range(30)] + [("bad.wav", bytearray(b"RIFF")), ("none.wav", bytearray(files.encode_wav(np.zeros(0), RATE)))]
    contents = spark.createDataFrame(wavs, "file string, content binary")
    for gate in (True, False):
        wanted = audio.preprocess(files.decoded(contents), gate=gate).where("error IS NULL").select(*(c.split()[0] for c in audio.SEGMENTS.split(", "))).orderBy("file", "segment").collect()
        got = files.decoded(contents, then=lambda b, gate=gate: audio.segment_frames(b, gate=gate), schema=audio.SEGMENTS).orderBy("file", "segment").collect()
        assert [tuple(x)[:-1] for x in got] == [tuple(x)[:-1] for x in wanted] and len(got) > 15
        assert all(np.allclose(a.waveform, b.waveform, atol=1e-6) for a, b in zip(got, wanted, strict=True))
