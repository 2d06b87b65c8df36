"""Alignment, agreement, evaluation, clean-up and audio operators against plain versions."""

import random
import re
import statistics

import numpy as np
import pytest

from parlance.functions import align, lexicon, sql, text
from parlance.operators import agreement, audio, evaluation, position, transcripts
from parlance.plans import queries
from pyspark.sql import functions as F


def edits(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def longest(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_alignment(spark):
    r = random.Random(4)
    words = ["a", "b", "c", "año", "日本", "😀", "está", "x" * 50]
    pairs = [([], []), ([], ["a"]), (["a"], [])] + [(r.choices(words, k=r.randint(0, 30)), r.choices(words, k=r.randint(0, 30))) for _ in range(80)]
    pairs.append(([str(i) for i in range(400)], [str(i) for i in range(1, 500)]))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, h array<string>, r array<string>")
    rows = df.select("i", align.token_edit_distance(F.col("h"), F.col("r")).alias("e"), align.lcs_length(F.col("h"), F.col("r")).alias("l")).orderBy("i").collect()
    for (a, b), row in zip(pairs, rows, strict=True):
        assert (row.e, row.l) == (edits(a, b), longest(a, b))
        assert row.l <= min(len(a), len(b)) and abs(len(a) - len(b)) <= row.e <= max(len(a), len(b))


def test_cer_against_plain_version(spark, sf_dir):
    got = {(r.conv_id, r.turn): r.cer for r in queries.pair_cer(spark, sf_dir).collect()}
    some = queries.pairs(spark, sf_dir).collect()
    assert len(got) == len(some)
    for p in sorted(some, key=lambda p: len(p.reference))[:40]:
        h, r = p.hypothesis.lower().strip(), p.reference.lower().strip()
        assert got[p.conv_id, p.turn] == pytest.approx(edits(h, r) / len(r), abs=1e-6)


def test_evaluation(spark):
    df = spark.createDataFrame([("a", "hola", "hola"), ("b", "Hola mundo", "hola"), ("c", "x", ""), ("d", None, "no sé")], "audio string, reference string, hypothesis string")
    rows = {r.audio: r for r in evaluation.pairs(df).collect()}
    assert rows["a"].exact_match and rows["a"].wer == 0 == rows["a"].cer
    assert rows["b"].wer == 0.5 and rows["b"].errors.deletions == 1 and rows["b"].errors.matched == 1
    assert rows["c"].wer == 1 and rows["d"].wer is None and rows["d"].cer is None
    e = evaluation.evaluate(df).first()
    assert e.n_samples == 4 and e.exact_match_rate == 0.25 and not e.meets_target
    none = evaluation.evaluate(df.limit(0)).first()
    assert (none.n_samples, none.avg_wer, none.meets_target) == (0, 0.0, False)
    assert evaluation.word_error_rate(df).first().wer == pytest.approx((0 + 1 + 1 + 2) / 4)


def test_compare(spark):
    a = spark.createDataFrame([(1, "uno dos", "-"), (2, "", "tres")], "k int, transcription string, hypothesis string")
    b = spark.createDataFrame([(1, "uno"), (2, "tres")], "k int, hypothesis string")
    assert {r.k: (r.reference, r.hypothesis) for r in evaluation.compare(a, b, "k").collect()} == {1: ("uno dos", "uno"), 2: ("tres", "tres")}
    other = spark.createDataFrame([(1, "uno"), (3, "tres")], "k int, hypothesis string")
    twice = spark.createDataFrame([(1, "uno"), (2, "dos"), (2, "tres")], "k int, hypothesis string")
    none = spark.createDataFrame([(1, "uno"), (None, "tres")], "k int, hypothesis string")
    for wrong in (b.limit(1), other, twice, none):
        with pytest.raises(ValueError, match="once"):
            evaluation.compare(a, wrong, "k")


def quadratic(a, b, m):
    n = m + 1
    o, w = np.zeros((n, n)), np.subtract.outer(np.arange(n), np.arange(n)) ** 2 / m**2
    for x, y in zip(a, b, strict=True):
        o[x, y] += 1 / len(a)
    e = np.outer(o.sum(1), o.sum(0))
    return 1 - (w * o).sum(), 1 - (w * e).sum()


def test_agreement(spark):
    r = random.Random(9)
    a = [r.randint(0, 6) for _ in range(205)]
    h = [min(6, max(0, x + r.choice((0, 0, 0, 1, -1, 3)))) for x in a]
    df = spark.createDataFrame([(i * 7, x, y) for i, (x, y) in enumerate(zip(a, h, strict=True))], "k long, a int, h int").repartition(3)
    d = [abs(x - y) for x, y in zip(a, h, strict=True)]
    po, pe = quadratic(a, h, 6)
    i = agreement.item_agreement(df, "a", "h").first()
    assert (i.n, i.max_diff, i.problem_cases) == (205, max(d), sum(x > 2 for x in d))
    assert i.std_diff == pytest.approx(statistics.pstdev(d)) and i.kappa_ratio == pytest.approx(po / pe)
    assert agreement.kappa(df, "a", "h").first().kappa == pytest.approx((po - pe) / (1 - pe))
    totals = [abs(sum(a[s : s + 20]) - sum(h[s : s + 20])) for s in range(0, 200, 20)]
    p = agreement.protocol_agreement(df, "a", "h", "k").first()
    assert (p.n_protocols, p.max_diff, p.mean_diff) == (10, max(totals), pytest.approx(sum(totals) / 10))
    few = df.where("k < 35")
    assert agreement.protocol_agreement(few, "a", "h", "k").first().n_protocols == 0
    s = agreement.score_difference_stats(few, "a", "h", "k").first()
    assert (s.n_protocols, s.mean_diff) == (1, abs(sum(a[:5]) - sum(h[:5])))
    table = agreement.confusion_table(df, "h", "a", list(range(7))).collect()
    assert sum(sum(row[1:]) for row in table) == 205
    assert agreement.top_disagreements(df, "a", "h", "k", 5).count() == 5
    report = agreement.report(df, "a", "h", "k").first()
    assert report.summary.meets_goal == (sum(x == 0 for x in d) / 205 >= 0.9)


def test_kappa_edges(spark):
    same = spark.createDataFrame([(3, 3), (3, 3)], "a int, b int")
    assert agreement.kappa(same, "a", "b").first() == (1.0, 1.0)
    uniform = spark.createDataFrame([(i % 7, i % 7) for i in range(70)], "a int, b int")
    k = agreement.kappa(uniform, "a", "b").first()
    assert k.kappa_ratio == pytest.approx(1.285714, abs=1e-6) and k.kappa == pytest.approx(1.0)


def test_positions(spark):
    keys = random.Random(1).sample(range(-10**9, 10**9), 500) + [10**15]
    rows = position.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()
    assert {r.k: r.position for r in rows} == {k: i for i, k in enumerate(sorted(keys))}
    some = spark.createDataFrame([(5,), (None,), (-3,)], "k long")
    assert {r.k: r.position for r in position.numbered(some, "k").collect()} == {-3: 0, 5: 1, None: 2}
    assert position.numbered(some.limit(0), "k").count() == 0


def cleaned(s: str) -> str:
    if not s.strip():
        return ""
    s = re.sub("[—–-]+", " ", re.sub(r"[.!?]+$", "", s.lower())).replace(",", "")
    s = re.sub("|".join(lexicon.DISFLUENCIES), " ", s, flags=re.I)
    for p, by in lexicon.SUBSTITUTIONS:
        s = re.sub(p, by, s, flags=re.I)
    return re.sub(r"\s+", " ", s).strip()


def test_postprocess_whole_query(spark, sf_dir):
    got = {(r.conv_id, r.turn): r.text for r in queries.postprocess(spark, sf_dir).collect()}
    for p in queries.pairs(spark, sf_dir).collect():
        assert got[p.conv_id, p.turn] == cleaned(f"Um, {p.reference} — este [ruido] fui... aber (risas) esta casa graned.")


def test_postprocess_cases(spark):
    said = ["  ", "Yo, eh, fui — al mercado...", "o sea pues salio a ver", "esta casa", "esta", "vino a vino", "umm [x] (y) ciudат", "no sé!?", None, "(a [b) c]", "[a (b] c)", "(este) pues [...]", "a...b", "o sea, o sea"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", text.postprocessed(F.col("s")).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == [cleaned(s or "") for s in said]


def test_merge_and_join(spark):
    parts = spark.createDataFrame([("a", 1.0, "dos", 0.5), ("a", 0.0, "uno", 1.0), ("a", 2.0, "", 0.0), ("b", 0.0, None, None)], "file string, start double, text string, conf double")
    rows = {r.file: r for r in transcripts.merge_segments(parts, ["file"], "start", "text", "conf").collect()}
    assert rows["a"].transcription == "uno dos" and rows["a"].confidence == 0.5 and rows["b"].transcription == "" and rows["b"].confidence is None
    every = spark.createDataFrame([("a",), ("b",), ("silent",)], "file string")
    rows = {r.file: r for r in transcripts.merge_segments(parts, ["file"], "start", "text", "conf", every).collect()}
    assert (rows["silent"].transcription, rows["silent"].confidence) == ("", 0.0) and rows["a"].transcription == "uno dos" and len(rows) == 3
    manifest = spark.createDataFrame([("x/a", "uno dos tres")], "audio string, reference string")
    assert transcripts.with_references(transcripts.merge_segments(parts, ["file"], "start", "text", "conf"), manifest).first().reference == "uno dos tres"
    logs = spark.createDataFrame([([-1.0, -3.0],), ([],)], "p array<double>").select(transcripts.mean_log_prob("p").alias("m")).collect()
    assert [r.m for r in logs] == [-2.0, 0.0]


def machine(flags, quiet, size, frame):
    """Segments of speech flags, frame by frame."""
    out, start, silent = [], None, 0
    for i, s in enumerate(flags):
        if s:
            start, silent = i if start is None else start, 0
        elif start is not None:
            silent += 1
            if silent >= quiet:
                out.append((start * frame, (i - silent) * frame))
                start, silent = None, 0
    if start is not None:
        out.append((start * frame, size))
    return out or [(0, size)]


def test_segments_whole_query(spark, sf_dir):
    got = {}
    for r in queries.waveform_segments(spark, sf_dir).collect():
        got.setdefault(r.vec_id, []).append((r.segment, r.start, r.end, r.samples))
    for row in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect():
        x = np.array(row.embedding, np.float64)
        expected = []
        for k, (a, b) in enumerate(machine(np.sqrt((x.reshape(-1, 4) ** 2).mean(1)) > 0.13, 2, len(x), 4)):
            loud = [i for i in range((b - a) // 4) if np.sqrt((x[a + 4 * i : a + 4 * i + 4] ** 2).mean()) > 0.13]
            if loud:
                a, b = a + 4 * loud[0], a + 4 * loud[-1] + 4
            expected.append((k, a, b, b - a))
        assert sorted(got[row.vec_id]) == expected


def test_audio(spark):
    t = np.arange(32000) / 16000
    x = np.where((t > 0.2) & (t < 1.5), np.sin(2 * np.pi * 440 * t), 0).astype(float)
    df = spark.createDataFrame([("f", [float(v) for v in x], 16000), ("quiet", [0.0] * 16000, 16000), ("none", [], 16000)], "file string, waveform array<float>, sample_rate int")
    rms = {r.file: r.r for r in df.select("file", audio.rms(audio.normalized(F.col("waveform"))).alias("r")).collect()}
    assert rms["f"] == pytest.approx(0.1, rel=1e-3) and rms["quiet"] == 0 == rms["none"]
    parts = {r.file: r for r in audio.preprocess(df).collect()}
    assert parts["f"].start_time == pytest.approx(0.2, abs=0.05) and parts["f"].end_time == pytest.approx(1.5, abs=0.1)
    assert "none" not in parts
    assert len(audio.resample(x, 16000, 8000)) == 16000
    assert np.abs(audio.spectral_gate(x) - x).max() < 0.05
    broken = df.withColumn("error", F.when(F.col("file") == "none", "bad file")).withColumn("sample_rate", F.when(F.col("file") != "quiet", F.col("sample_rate")))
    rows = {r.file: r for r in audio.spectral(broken).collect()}
    assert rows["f"].error is None and len(rows["f"].waveform) == 32000 and rows["none"].error == "bad file" and rows["quiet"].error and rows["quiet"].waveform == []


def test_frame_segments(spark):
    flags = [0, 1, 1, 0, 0, 1, 0, 0, 0, 1, 1, 0]
    df = spark.createDataFrame([("u", i, bool(f)) for i, f in enumerate(flags)], "u string, i int, s boolean")
    rows = audio.frame_segments(df, ["u"], "i", F.col("s"), 3).orderBy("start_frame").collect()
    assert [(r.start_frame, r.end_frame) for r in rows] == machine(flags, 3, 12, 1)


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT norm_text(' ¡Yo,  FUÍ!') n, token_recall(array('a', 'b'), array('a', 'c')) t, token_edit_distance(array('a', 'b'), array('b')) e, wer(array(), array('x')) w, lcs_length(array('a', 'b'), array('b')) l, jaccard(array('a'), array('a', 'b')) j").first()
    assert tuple(row) == ("yo fuí", 0.5, 1, 1.0, 1, 0.5)
    spark.createDataFrame([("a", "a")], "hypothesis string, reference string").createOrReplaceTempView("said")
    sql.scored_view(spark, "said", "scored")
    assert spark.sql("SELECT score FROM scored").first().score == 6


def test_edit_distance_words_once(spark):
    """The shared tokens of a row are a lambda's argument, not computed again inside it."""
    plan = spark.createDataFrame([(["a"], ["b"])], "h array<string>, r array<string>").select(align.token_edit_distance(F.col("h"), F.col("r")).alias("d"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1


def test_report_text(spark, capsys):
    df = spark.createDataFrame([(i, "uno dos", "uno dos" if i % 2 else "uno tres", i % 7, i % 7) for i in range(40)], "k int, hypothesis string, reference string, a int, h int")
    said = evaluation.print_report(df, "a", "h", "k")
    assert capsys.readouterr().out == said + "\n" and "25.0%" in said and "100.0%" in said
    assert "-" in evaluation.print_report(df.limit(0), "a", "h", "k")


def test_many_labels(spark):
    df = spark.range(3000).selectExpr("id AS a", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS b")
    with pytest.raises(ValueError, match="more than 1000"):
        agreement.confusion_matrix(df, "a", "b")
    few = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "a int, b int")
    assert agreement.confusion_matrix(few, "a", "b", most=3).count() == 9
    got = {r.label: r.n for r in agreement.frequent_labels(df, "a", "b", share=0.1).collect()}
    assert got == {7: 1002}
    assert agreement.frequent_labels(df.limit(0), "a").count() == 0


def test_frequent_labels_miss_none(spark):
    """Frequent ones among many rare ones, in any order and number of tasks; nulls don't count."""
    rows = [(f"rare {i}",) for i in range(5000)] + [("often",)] * 300 + [("just",)] * 112 + [("less",)] * 107 + [(None,)] * 4000
    random.Random(4).shuffle(rows)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "t string").repartition(parts)
        total = 5000 + 300 + 112 + 107
        got = {r.label: r.n for r in agreement.frequent_labels(df, "t", share=0.02).collect()}
        assert got == {k: n for k, n in (("often", 300), ("just", 112), ("less", 107)) if n >= 0.02 * total}


def test_quantiles(spark):
    """Ranks within the error of the summary, in groups of any size."""
    r = random.Random(3)
    rows = [(g, r.gauss(0, 1)) for g in range(4) for _ in range((1, 10, 3000, 20_000)[g])] + [(0, None)]
    got = agreement.quantiles(spark.createDataFrame(rows, "g int, x double").repartition(5), "x", [0.0, 0.5, 0.99], ["g"], error=0.01).collect()
    assert len(got) == 12
    for q in got:
        values = [x for g, x in rows if g == q.g and x is not None]
        slack = 0.01 + 1 / len(values)
        assert sum(x < q.value for x in values) / len(values) <= q.probability + slack and sum(x <= q.value for x in values) / len(values) >= q.probability - slack
