"""Streamed segmentation: the islands of a batch, frames out of order, frames that come too late, and the end of a recording."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import audio
from parlance.streaming import segments


def machine(flags, quiet, short_end):
    n, start, last, closed = segments.advance(0, -1, -1, flags, quiet, short_end)
    return closed + ([(start, n, True)] if start >= 0 else [])


def test_steps_make_the_whole():
    """However the frames are dealt to steps, the islands are the same."""
    r = random.Random(1)
    for _ in range(300):
        flags = [r.random() < 0.3 for _ in range(r.randint(0, 60))]
        n, start, last, out = 0, -1, -1, []
        at = 0
        while at < len(flags):
            size = r.randint(0, 9)
            n, start, last, closed = segments.advance(n, start, last, flags[at : at + size], 3, True)
            out += closed
            at += size
        assert out + ([(start, n, True)] if start >= 0 else []) == machine(flags, 3, True)


def streamed(spark, tmp_path, batches, late="2 minutes", idle="1 hour"):
    """Rows of (key, ts seconds, tie, speech) batch by batch; returns the islands, in the order they came."""
    source = str(tmp_path / "in")
    schema = "k string, ts timestamp, i long, s boolean"
    name = f"islands_{abs(hash(str(tmp_path)))}"
    spark.createDataFrame([], schema).write.parquet(source)
    frames = spark.readStream.schema(schema).parquet(source)
    q = segments.segment_stream(frames, ["k"], "ts", "i", "s", 3, late, idle).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        for b in batches:
            rows = spark.createDataFrame([(k, t, i, s) for k, t, i, s in b], "k string, t long, i long, s boolean")
            rows.select("k", F.timestamp_seconds("t").alias("ts"), "i", "s").coalesce(1).write.mode("append").parquet(source)
            q.processAllAvailable()
        return [tuple(r) for r in spark.table(name).collect()]
    finally:
        q.stop()


END = [("clock", 10**9, 0, False)]


def test_same_as_the_batch(spark, tmp_path, sf_dir):
    """The events of every user, out of order within the watermark and in three batches, give the rows of the batch operator."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.coalesce(F.col("value") > 50, F.lit(False)).alias("s"))
    wanted = {(str(r.user_id), r.start_frame, r.end_frame, r.tail) for r in audio.frame_segments(events, ["user_id"], "event_id", F.col("s"), 3).collect()}
    rows = [(str(r.user_id), 1000 + r.event_id, r.event_id, r.s) for r in events.collect()]
    r = random.Random(2)
    # a frame moves by less than the watermark waits
    rows.sort(key=lambda x: x[1] + r.uniform(-50, 50))
    third = len(rows) // 3
    got = streamed(spark, tmp_path, [rows[:third], rows[third : 2 * third], rows[2 * third :], END])
    assert {x for x in got if x[0] != "clock"} == wanted and len(got) == len(wanted)


def test_late_frames(spark, tmp_path):
    """A frame within the watermark takes its place; one behind it is left out."""
    first = [("a", t, t, t < 103) for t in range(100, 110) if t != 105] + [("clock", 200, 0, False)]
    # the watermark is at 80: 105 comes in time; after the clock's 400 it is at 280, and 101 comes too late
    got = streamed(spark, tmp_path, [first, [("a", 105, 105, True), ("clock", 400, 1, False)], [("a", 101, 1, True), ("a", 300, 300, True)], END])
    flags = [t < 103 or t == 105 for t in range(100, 110)] + [True]
    assert [x[1:] for x in got if x[0] == "a"] == machine(flags, 3, True)


def test_end_of_a_recording(spark, tmp_path):
    """An open island is returned once its recording has been idle; frames after that begin another recording."""
    got = streamed(spark, tmp_path, [[("a", t, t, True) for t in range(100, 104)], [("clock", 5000, 0, False)], [("a", 6000, 1, True), ("b", 6000, 1, False)], END], idle="10 minutes")
    assert [x for x in got if x[0] != "clock"] == [("a", 0, 4, True), ("a", 0, 1, True)]


@pytest.mark.parametrize("short_end", [True, False])
def test_machine_against_frames(spark, short_end):
    r = random.Random(5)
    rows = [(k, i, r.random() < 0.35) for k in range(20) for i in range(r.randint(1, 50))]
    df = spark.createDataFrame(rows, "k int, i int, s boolean")
    got = {}
    for x in audio.frame_segments(df, ["k"], "i", F.col("s"), 3, short_end).collect():
        got.setdefault(x.k, []).append((x.start_frame, x.end_frame, x.tail))
    for k in range(20):
        assert sorted(got.get(k, [])) == machine([s for a, _, s in rows if a == k], 3, short_end)
