"""Sources, sinks, commands and streams."""

import json
import wave

import numpy as np
import pytest

from parlance import cli
from parlance.operators import position
from parlance.sources import files
from parlance.streaming import scoring

CSV = 'hypothesis,reference\n"yo, ""fui""",yo fui\n"dos\nlíneas",dos líneas\n,nada\n'


def read(folder):
    return [json.loads(x) for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def test_score_and_validate(spark, tmp_path):
    (tmp_path / "in.csv").write_text(CSV)
    out = cli.main(["score", "--input-csv", str(tmp_path / "in.csv"), "--output-csv", str(tmp_path / "out"), "--use-ensemble"], spark)
    assert sorted(r.auto_score for r in out.collect()) == [0, 6, 6]
    back = files.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["hypothesis", "reference", "auto_score", "reasoning", "confidence", "category"] and back.count() == 3
    (tmp_path / "s.csv").write_text("auto_score,human_score\n" + "".join(f"{i % 7},{i % 7}\n" for i in range(45)))
    cli.main(["validate", "--scored-csv", str(tmp_path / "s.csv"), "--output-json", str(tmp_path / "v")], spark)
    [v] = read(tmp_path / "v")
    assert v["item_level"]["exact"] == 1 and v["protocol_level"]["n_protocols"] == 2 and v["summary"]["meets_goal"]
    (tmp_path / "few.csv").write_text("auto_score,human_score\n1,2\n")
    cli.main(["validate", "--scored-csv", str(tmp_path / "few.csv"), "--output-json", str(tmp_path / "w")], spark)
    assert read(tmp_path / "w")[0]["protocol_level"]["mean_diff"] is None


def test_compare_evaluate_batch(spark, tmp_path):
    (tmp_path / "r.csv").write_text("auto_score,human_score\n1,2\n3,3\n")
    cli.main(["compare-raters", "--input-csv", str(tmp_path / "r.csv"), "--output-json", str(tmp_path / "c")], spark)
    assert read(tmp_path / "c")[0]["metrics"]["exact"] == 0.5
    (tmp_path / "t.csv").write_text("transcription,reference\nhola,hola\nmal,bien\n")
    cli.main(["evaluate", "--results-csv", str(tmp_path / "t.csv"), "--output-json", str(tmp_path / "e")], spark)
    assert read(tmp_path / "e")[0] == {"wer": 0.5, "agreement": 0.5, "samples": 2, "goal_wer": 0.1, "meets_target": False}
    (tmp_path / "b.json").write_text(json.dumps([{"hypothesis": "a"}, {"hypothesis": "a", "reference": "a"}]))
    cli.main(["score-batch", "--sentences-json", str(tmp_path / "b.json"), "--output-json", str(tmp_path / "s")], spark)
    assert [r["score"] for r in document(tmp_path / "s")] == [1, 6]
    (tmp_path / "empty.json").write_text("[]")
    cli.main(["score-batch", "--sentences-json", str(tmp_path / "empty.json"), "--output-json", str(tmp_path / "s0")], spark)
    with pytest.raises(ValueError, match="reference"):
        (tmp_path / "x.csv").write_text("transcription\nhola\n")
        cli.main(["evaluate", "--results-csv", str(tmp_path / "x.csv"), "--output-json", str(tmp_path / "x")], spark)


def test_audio_files(spark, tmp_path):
    sound = tmp_path / "sound"
    sound.mkdir()
    with wave.open(str(sound / "b.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes((np.full((400, 2), [0.5, -0.25]) * 32767).astype("<i2").tobytes())
    (sound / "a.wav").write_bytes(b"no sound")
    (sound / "c.mp3").write_bytes(b"-")
    (sound / "notes.txt").write_text("-")
    rows = {r.file: r for r in files.read_wav(spark, str(sound)).collect()}
    assert rows["b.wav"].sample_rate == 8000 and rows["b.wav"].waveform[0] == pytest.approx(0.125, abs=1e-3) and len(rows["b.wav"].waveform) == 400
    assert rows["a.wav"].error and rows["a.wav"].waveform == []
    assert [r.file for r in files.list_audio(spark, str(sound)).collect()] == ["a.wav", "b.wav", "c.mp3"]
    cli.main(["create-manifest", "--input-dir", str(sound), "--output-manifest", str(tmp_path / "m")], spark)
    assert [m["audio"] for m in read(tmp_path / "m")] == ["a.wav", "b.wav", "c.mp3"]
    with pytest.raises(SystemExit):
        cli.main(["transcribe", "--audio-dir", str(sound), "--output-csv", str(tmp_path / "t")], spark)


def test_streams(spark, tmp_path):
    source = str(tmp_path / "pairs")
    spark.createDataFrame([("a", "a"), ("", "b")], files.PAIRS).write.parquet(source)
    q = scoring.score_stream(scoring.pair_stream(spark, source, files.PAIRS)).writeStream.format("memory").queryName("scored_stream").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.score for r in spark.table("scored_stream").collect()) == [0, 6]
    source = str(tmp_path / "ratings")
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' ts, 1 a, 2 b UNION ALL SELECT timestamp'2024-01-01 00:02:00', 3, 3 UNION ALL SELECT timestamp'2024-01-01 00:07:00', 5, 5").write.parquet(source)
    ratings = scoring.pair_stream(spark, source, "ts timestamp, a int, b int")
    q = scoring.windowed_agreement(ratings, "a", "b").writeStream.outputMode("complete").format("memory").queryName("agreed").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.exact) for r in spark.table("agreed").collect()) == [(1, 1.0), (2, 0.5)]


def test_round_trips(spark, tmp_path):
    texts = [(1, ' "a", \n b\r\n'), (2, None), (3, ""), (4, "  "), (5, "#x\\"), (6, "ñandú 日本")]
    files.write_csv(spark.createDataFrame(texts, "i int, t string"), str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), "i int, t string").collect())) == texts
    many = spark.range(50).selectExpr("concat('h', id) AS hypothesis", "CASE WHEN id % 2 = 0 THEN 'r' END AS reference").repartition(3)
    files.write_json(many, str(tmp_path / "lines"))
    back = files.read_json(spark, str(tmp_path / "lines"))
    assert back.count() == 50 and back.where("reference = ''").count() == 25
    for name, rows in (("one", '[{"hypothesis": "a"}, {"hypothesis": "b", "reference": "}"}]'), ("more", '\n[\n{"hypothesis": "a"},\n{"hypothesis":\n"b", "reference": "}"}\n]\n')):
        (tmp_path / name).write_text(rows)
        assert sorted(map(tuple, files.read_json(spark, str(tmp_path / name)).collect())) == [("a", ""), ("b", "}")]
    (tmp_path / "object").write_text('{\n"hypothesis": "a"\n}')
    assert [r.hypothesis for r in files.read_json(spark, str(tmp_path / "object")).collect()] == ["a"]
    (tmp_path / "none").write_text("")
    assert files.read_json(spark, str(tmp_path / "none")).count() == 0


def test_one_line_rows(spark, tmp_path):
    """Line ends and backslashes within cells, in files that are read in splits."""
    texts = [(1, "a\nb"), (2, "a\\nb"), (3, "\r\n"), (4, "\\"), (5, "\\\\n\n"), (6, None), (7, ""), (8, ' "q", '), (9, "\0 0\x001"), (10, "\\r\r\\")]
    files.write_csv(spark.createDataFrame(texts, "i int, t string"), str(tmp_path / "csv"), one_line=True)
    lines = [x for p in (tmp_path / "csv").glob("part-*") for x in p.read_bytes().split(b"\n") if x]
    assert sum(x != b"i,t" for x in lines) == len(texts)
    df = files.read_csv(spark, str(tmp_path / "csv"), "i int, t string", one_line=True)
    assert sorted(map(tuple, df.collect())) == texts
    # one column, in which blank lines would be none
    blank = [("",), (" ",), (" \t ",), (None,), ("\n",), ("\\N",), ("\\e",)]
    files.write_csv(spark.createDataFrame(blank, "t string"), str(tmp_path / "blank"), one_line=True)
    back = files.read_csv(spark, str(tmp_path / "blank"), "t string", one_line=True)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(blank, key=repr)


@pytest.mark.parametrize("splits", ["128m", "300"])
def test_positions_in_files(spark, tmp_path, splits):
    """Positions by file and line, however the files are split and dealt to tasks."""
    said = [f"word {i} " * (i % 5) for i in range(400)]
    bounds = [0, 1, 1, 57, 230, 400]
    (tmp_path / "in").mkdir()
    for k, (a, z) in enumerate(zip(bounds, bounds[1:], strict=False)):
        (tmp_path / "in" / f"part-{k}.csv").write_text("i,t\n" + "".join(f"{i},{said[i]}\n" for i in range(a, z)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", splits)
    try:
        df = files.read_csv(spark, str(tmp_path / "in"), "i long, t string", one_line=True)
        out, n = position.in_files(df)
        assert n == 400 and df.rdd.getNumPartitions() > (10 if splits == "300" else 0)
        assert sorted((r.position, r.i) for r in out.collect()) == [(i, i) for i in range(400)]
        assert out.columns == ["i", "t", "position"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    none, n = position.in_files(files.read_csv(spark, str(tmp_path / "in" / "part-1.csv"), "i long, t string"))
    assert n == 0 and none.count() == 0


def document(folder):
    return json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))


def test_compare_transcripts(spark, tmp_path):
    one = ["hola mundo", "", "a\nb", 'dos "tres"']
    two = ["hola", "x", "a\nb", "dos"]
    for name, texts, parts in (("a", one, 3), ("b", two, 1)):
        rows = spark.createDataFrame([(i, t, "else") for i, t in enumerate(texts)], "i int, transcription string, hypothesis string")
        files.write_csv(rows.repartitionByRange(parts, "i").sortWithinPartitions("i"), str(tmp_path / name))
    out = cli.main(["compare-transcripts", "--baseline-csv", str(tmp_path / "a"), "--test-csv", str(tmp_path / "b"), "--output-json", str(tmp_path / "out")], spark)
    got = document(tmp_path / "out")
    assert [s["audio_file"] for s in got["samples"]] == ["sample_000", "sample_001", "sample_002", "sample_003"]
    assert [s["reference"] for s in got["samples"]] == ["hola mundo", "else", "a\nb", 'dos "tres"'] and [s["hypothesis"] for s in got["samples"]] == two
    assert [s["wer"] for s in got["samples"]] == [0.5, 1.0, 0.0, 0.5]
    assert got["n_samples"] == 4 and got["avg_wer"] == 0.5 and got["target_wer"] == 0.1 and out.first().avg_wer == 0.5
    files.join_parts(spark, str(tmp_path / "out"), str(tmp_path / "one.json"))
    assert json.loads((tmp_path / "one.json").read_text()) == got
    files.write_csv(spark.createDataFrame([("x",)], "transcription string"), str(tmp_path / "few"))
    with pytest.raises(ValueError, match="same number of rows: 4 and 1"):
        cli.main(["compare-transcripts", "--baseline-csv", str(tmp_path / "a"), "--test-csv", str(tmp_path / "few"), "--output-json", str(tmp_path / "no")], spark)


def test_validate_of_many_files(spark, tmp_path):
    """The same protocols, whether the ratings are in one file or in many."""
    rows = spark.range(95).selectExpr("id", "CAST(id * 5 % 7 AS INT) AS auto_score", "CAST(least(6, id * 5 % 7 + (id % 3)) AS INT) AS human_score")
    reports = []
    for parts in (1, 4):
        at = str(tmp_path / f"in{parts}")
        files.write_csv(rows.repartitionByRange(parts, "id").sortWithinPartitions("id").drop("id"), at)
        cli.main(["validate", "--scored-csv", at, "--output-json", str(tmp_path / f"v{parts}")], spark)
        reports += read(tmp_path / f"v{parts}")
    assert reports[0] == reports[1] and reports[0]["protocol_level"]["n_protocols"] == 4


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_documents_in_parts(spark, tmp_path, n):
    rows = spark.range(n).selectExpr("CAST(id AS INT) AS i", "concat('t\"\\n,', id) AS hypothesis", "CASE WHEN id % 2 = 0 THEN 'r' END AS reference").repartitionByRange(7, "i").sortWithinPartitions("i")
    files.write_array(rows, str(tmp_path / "array"))
    wanted = [{"i": i, "hypothesis": f't"\n,{i}', "reference": None if i % 2 else "r"} for i in range(n)]
    assert document(tmp_path / "array") == wanted
    back = files.read_json(spark, str(tmp_path / "array"), "i int, hypothesis string, reference string").orderBy("i")
    assert [r.asDict() for r in back.collect()] == [{**w, "reference": w["reference"] or ""} for w in wanted]
    files.write_nested(spark.createDataFrame([(n, None)], "n int, x string"), rows, "all", str(tmp_path / "nested"))
    assert document(tmp_path / "nested") == {"n": n, "x": None, "all": wanted}


def test_no_task_reads_all_lines(spark, tmp_path, monkeypatch):
    """nothing of a document in parts is gathered from all lines in one task."""
    rows = spark.range(2000, numPartitions=6)

    def gathers(self, n):
        raise AssertionError(f"coalesce({n})")

    monkeypatch.setattr(type(rows), "coalesce", gathers)
    files.write_array(rows, str(tmp_path / "out"))
    assert [x["id"] for x in document(tmp_path / "out")] == list(range(2000))
