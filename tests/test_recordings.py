"""Long recordings: the data source's blocks, and the preprocessor over blocks against the whole signal."""

import wave

import numpy as np
import pyarrow.parquet as pq
import pytest

from parlance.operators import audio, batches, recordings
from parlance.plans import spoken
from parlance.sources import files, wav


def made_sound(seed: int, rate: int, seconds: float, channels: int = 1) -> np.ndarray:
    """Noise, tones and silence in turn."""
    r = np.random.default_rng(seed)
    out = [r.normal(0, 0.002, int(0.6 * rate))]
    while sum(map(len, out)) < seconds * rate:
        n = int(r.uniform(0.1, 1.7) * rate)
        t = np.arange(n) / rate
        out.append(r.choice([0, 0.3]) * np.sin(2 * np.pi * r.uniform(100, 900) * t) + r.normal(0, 0.002, n))
    x = np.concatenate(out)[: int(seconds * rate)]
    return x if channels == 1 else np.stack([x, 0.5 * x], 1)


@pytest.fixture(scope="module")
def sounds(tmp_path_factory):
    at = tmp_path_factory.mktemp("sounds")
    made = {"a": (1, 16000, 7.3, 1), "b": (2, 44100, 5.01, 2), "c": (3, 8000, 9.0, 1), "d": (4, 48000, 0.7, 1), "e": (5, 16000, 0.02, 1), "f": (6, 22050, 3.0, 1)}
    for name, (seed, rate, seconds, channels) in made.items():
        (at / f"{name}.wav").write_bytes(files.encode_wav(made_sound(seed, rate, seconds, channels), rate))
    (at / "silent.WAV").write_bytes(files.encode_wav(np.zeros(16000 * 4), 16000))
    (at / "none.wav").write_bytes(files.encode_wav(np.zeros(0), 16000))
    (at / "bad.wav").write_bytes(b"RIFF")
    (at / "notes.txt").write_text("-")
    return at


def test_headers(spark, sounds):
    rows = {r.file: r for r in wav.read_headers(spark, str(sounds)).collect()}
    assert sorted(rows) == ["a.wav", "b.wav", "bad.wav", "c.wav", "d.wav", "e.wav", "f.wav", "none.wav", "silent.WAV"]
    b = rows["b.wav"]
    assert (b.sample_rate, b.channels, b.n_frames, b.error) == (44100, 2, int(5.01 * 44100), None) and b.duration == pytest.approx(5.01, abs=1e-4)
    assert rows["bad.wav"].error == "no WAV file" and rows["none.wav"].n_frames == 0


@pytest.mark.parametrize("split", [20_000, 64 << 20])
def test_blocks(spark, sounds, split):
    """Blocks make up the samples of each file, however the files are split, with their neighbours' samples around them."""
    df = wav.read_blocks(spark, f"file://{sounds}" if split == 20_000 else str(sounds), seconds=1, split=split)
    assert (df.rdd.getNumPartitions() > 30) == (split == 20_000)
    rows = df.collect()
    whole = {r.file: r for r in files.read_audio(spark, str(sounds), pattern="*.{wav,WAV}").collect()}
    assert {r.file for r in rows} == set(whole)
    for name, w in whole.items():
        mine = sorted((r for r in rows if r.file == name), key=lambda r: r.block)
        if w.error:
            assert len(mine) == 1 and mine[0].error
            continue
        assert [r.block for r in mine] == list(range(max(1, -(-len(w.waveform) // w.sample_rate))))
        assert [x for r in mine for x in r.waveform[r.lead : r.lead + r.length]] == w.waveform
        for r in mine:
            assert r.waveform == w.waveform[r.start - r.lead : r.start - r.lead + len(r.waveform)]
            assert r.start == 0 or r.lead >= 0.04 * w.sample_rate


def test_odd_headers(spark, tmp_path):
    """Widths, chunks before the samples, sizes left open, other formats."""
    x = np.array([0.0, 0.5, -0.5, 0.25])
    plain = files.encode_wav(x, 8000)
    data = plain.index(b"data")
    (tmp_path / "list.wav").write_bytes(plain[:data] + b"LIST\x03\0\0\0abc\0" + plain[data:])
    (tmp_path / "open.wav").write_bytes(plain[: data + 4] + b"\xff\xff\xff\xff" + plain[data + 8 :])
    (tmp_path / "float.wav").write_bytes(plain[:20] + b"\x03\0" + plain[22:])
    (tmp_path / "cut.wav").write_bytes(plain[:-3])
    for width in (1, 3, 4):
        with wave.open(str(tmp_path / f"w{width}.wav"), "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(width)
            f.setframerate(8000)
            y = np.rint(x * 2 ** (8 * width - 1)).astype(np.int64)
            f.writeframes(b"".join(int(v + 128).to_bytes(1, "little") if width == 1 else int(v).to_bytes(width, "little", signed=True) for v in y))
    rows = {r.file: r for r in wav.read_blocks(spark, str(tmp_path)).collect()}
    assert "not PCM: format 3" in rows.pop("float.wav").error
    assert len(rows.pop("cut.wav").waveform) == 2
    assert all(np.allclose(r.waveform, x, atol=1e-2) and r.error is None for r in rows.values()) and len(rows) == 5


@pytest.mark.parametrize("gate", [True, False])
def test_as_the_whole_signal(spark, sounds, gate):
    whole = audio.preprocess(files.read_audio(spark, str(sounds), pattern="*.{wav,WAV}").where("error IS NULL"), gate=gate)
    wanted = {(r.file, r.segment): r for r in whole.collect()}
    blocks = wav.read_blocks(spark, str(sounds), seconds=1).cache()
    got = {(r.file, r.segment): r for r in recordings.segments(blocks, gate=gate).collect()}
    assert set(got) == set(wanted) and len(got) > 8
    for k, r in got.items():
        w = wanted[k]
        assert (r.start_time, r.end_time, r.sample_rate) == (w.start_time, w.end_time, 16000) and len(r.waveform) == len(w.waveform)
        assert np.abs(np.array(r.waveform) - np.array(w.waveform)).max() < 1e-5


def test_parts_of_a_signal():
    """Any piece of the resampled and gated signal, from the samples around it."""
    r = np.random.default_rng(9)
    for rate in (8000, 16000, 44100):
        x = r.normal(size=rate * 2)
        whole = audio.resample(x, rate, 16000)
        for a, z in ((0, 100), (15_000, 17_000), (31_000, 32_000)):
            lo, hi = max(0, a * rate // 16000 - 100), min(len(x), z * rate // 16000 + 100)
            assert np.allclose(recordings.resample_part(x[lo:hi], lo, a, z, rate, 16000), whole[a:z], atol=1e-9)
    y = r.normal(size=20_001)
    gated = audio.spectral_gate(y)
    profile = recordings.noise(y, 0, len(y), audio.Audio())
    for a, z in ((0, 300), (5_000, 9_000), (19_000, 20_001)):
        lo, hi = max(0, a - 512), min(len(y), z + 512)
        assert np.allclose(recordings.gate_part(y[lo:hi], lo, a, z, len(y), profile, audio.Audio()), gated[a:z], atol=1e-9)


def test_loud_threshold(spark, sounds):
    """Where the threshold is above what one sample at the limit makes of a frame, frames are judged as held within the limits."""
    loud = audio.Audio(silence_db=-6, target_rms=1.2, shortest=0.05)
    assert loud.threshold * loud.frame**0.5 > 1
    whole = audio.preprocess(files.read_audio(spark, str(sounds), pattern="*.{wav,WAV}").where("error IS NULL"), loud)
    wanted = {(r.file, r.segment): (r.start_time, r.end_time, len(r.waveform)) for r in whole.collect()}
    got = {(r.file, r.segment): (r.start_time, r.end_time, len(r.waveform)) for r in recordings.segments(wav.read_blocks(spark, str(sounds), seconds=1), loud).collect()}
    assert got == wanted and len(got) > 8


def test_large_rows_in_small_batches(spark, tmp_path, sf_dir):
    """no row group, so no batch of a reader, and no batch of derived sounds has more than a few large rows."""
    made = spoken.contents(spark, sf_dir).coalesce(1)
    batches.write_large(made, str(tmp_path / "out"))
    [path] = (tmp_path / "out").glob("*.parquet")
    meta = pq.ParquetFile(path).metadata
    assert meta.num_rows > batches.ROWS >= max(meta.row_group(i).num_rows for i in range(meta.num_row_groups))
    rows = [(i, np.zeros(1000, np.float32)) for i in range(50)]
    got = list(batches.batched(rows, "i, x", 10_000))
    assert {len(b) for b in got} == {3, 2} and [i for b in got for i in b["i"]] == list(range(50))


def test_samples_stay_where_they_are(spark, tmp_path):
    """each block is gated twice, and samples of segments that lie in one block aren't shuffled."""
    x = made_sound(7, 16000, 5)
    contents = spark.createDataFrame([("a.wav", bytearray(files.encode_wav(x, 16000)))], "file string, content binary")
    batches.write_large(wav.blocks_of(contents, seconds=30), str(tmp_path / "blocks"))
    numbers = recordings.measured(spark.read.parquet(str(tmp_path / "blocks")))
    assert "waveform" not in numbers.columns and [r.profile for r in numbers.collect()] == [None]
    plan = recordings.segments(spark.read.parquet(str(tmp_path / "blocks")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2
