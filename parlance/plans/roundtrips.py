"""Registered queries of sources, sinks and commands: files are written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import cli
from parlance.functions import text
from parlance.operators import audio, batches, evaluation, recordings, transcripts
from parlance.plans import spoken
from parlance.plans.derive import pairs, ratings
from parlance.session import folder
from parlance.sources import files, wav

KEY = ("conv_id", "turn")


def _six(c) -> F.Column:
    return F.round(c, 6)


def _command(spark: SparkSession, name: str, source: str, sink: str, *options: str) -> str:
    """Run a command from a file that an option `source` names to a new one that `sink` names, whose path it returns."""
    path, out = source.split("=", 1)[1], folder(spark)
    cli.main([name, source.split("=", 1)[0], path, sink, out, *options], spark)
    return out


def _csv(df: DataFrame) -> str:
    path = folder(df.sparkSession)
    files.write_csv(df, path)
    return path


def csv_texts(spark, sf_dir):
    """Whole texts through CSV, with their quotes, line ends, outer spaces, nulls and empty ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = files.read_csv(spark, _csv(docs), "doc_id long, text string", ("doc_id", "text"))
    return back.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("md5"))


def score_command(spark, sf_dir):
    path = _csv(pairs(spark, sf_dir).select(*KEY, "hypothesis", "reference"))
    out = _command(spark, "score", f"--input-csv={path}", "--output-csv")
    schema = "conv_id long, turn long, hypothesis string, reference string, auto_score int, reasoning string, confidence double, category string"
    return files.read_csv(spark, out, schema).select(*KEY, "auto_score", "reasoning", _six("confidence").alias("confidence"), "category")


def score_batch_command(spark, sf_dir):
    """Pairs as JSON lines, scored to JSON lines; counts of what was read back."""
    path = folder(spark)
    files.write_json(pairs(spark, sf_dir).select("hypothesis", "reference"), path)
    out = _command(spark, "score-batch", f"--sentences-json={path}", "--output-json")
    back = files.read_json(spark, out, "hypothesis string, reference string, score int, category string, reasoning string, confidence double, errors array<string>")
    return back.groupBy("score", "category").agg(F.count("*").alias("n"), F.sum(F.size("errors")).alias("n_errors"), _six(F.avg("confidence")).alias("confidence"), F.sum(F.length("reference")).alias("n_chars"))


def evaluate_command(spark, sf_dir):
    path = _csv(pairs(spark, sf_dir).select(F.col("hypothesis").alias("transcription"), "reference"))
    out = _command(spark, "evaluate", f"--results-csv={path}", "--output-json")
    back = files.read_json(spark, out, "wer double, agreement double, samples long, goal_wer double, meets_target boolean")
    return back.select(_six("wer").alias("wer"), _six("agreement").alias("agreement"), "samples", "goal_wer", "meets_target")


def validate_command(spark, sf_dir):
    """The parts that don't depend on the order of a folder's files."""
    path = _csv(ratings(spark, sf_dir).select(F.col("auto").alias("auto_score"), F.col("human").alias("human_score")))
    out = _command(spark, "validate", f"--scored-csv={path}", "--output-json")
    back = files.read_json(spark, out, "item_level struct<n:long,mean_diff:double,exact:double>, protocol_level struct<n_protocols:long>, summary struct<meets_goal:boolean>")
    return back.select("item_level.n", _six("item_level.mean_diff").alias("mean_diff"), _six("item_level.exact").alias("exact"), "protocol_level.n_protocols", "summary.meets_goal")


def compare_raters_command(spark, sf_dir):
    path = _csv(ratings(spark, sf_dir).select(F.col("auto").alias("ana_score"), F.col("human").alias("luis_score")))
    out = _command(spark, "compare-raters", f"--input-csv={path}", "--output-json", "--scorer-a", "ana", "--scorer-b", "luis")
    back = files.read_json(spark, out, "comparison string, metrics struct<n:long,mean_diff:double,max_diff:long,exact:double,within_1:double,kappa_ratio:double>")
    m = [F.col(f"metrics.{c}") for c in ("n", "max_diff")] + [_six(f"metrics.{c}").alias(c) for c in ("mean_diff", "exact", "within_1", "kappa_ratio")]
    return back.select("comparison", *m)


def manifest_join(spark, sf_dir):
    """A manifest of files written and read again, with the transcripts that have their names."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.format_string("%06d.wav", "page_id").alias("file"))
    path = folder(spark)
    files.write_json(files.manifest(pages.select(F.concat(F.lit("sound/day 1/"), "file").alias("file"))), path)
    said = pages.withColumn("transcription", F.concat(F.lit("said in "), "file"))
    return transcripts.with_references(said, files.read_json(spark, path, files.MANIFEST)).select("file", "transcription", "reference")


def transcription_csv(spark, sf_dir):
    """A conversation's turns as a file's segments, of which the empty ones go; files without any keep a row; through CSV."""
    turns = pairs(spark, sf_dir).withColumn("confidence", F.col("pair_id") % 5 / 8)
    spoken = turns.where(F.trim("hypothesis") != "")
    merged = transcripts.merge_segments(spoken, ["conv_id"], "turn", "hypothesis", "confidence", turns)
    back = files.read_csv(spark, _csv(merged.select(F.col("conv_id").alias("file"), "transcription", "confidence")), "file long, transcription string, confidence double")
    return back.select("file", "transcription", _six("confidence").alias("confidence"))


def evaluation_files(spark, sf_dir):
    """The samples and the summary of an evaluation, written beside each other and read again."""
    p = pairs(spark, sf_dir)
    path = folder(spark)
    files.write_evaluation(evaluation.evaluate(p).select("n_samples", "avg_wer", "exact_match_rate"), evaluation.pairs(p).select(F.col("pair_id").alias("sample"), "wer", "exact_match"), path)
    samples = files.read_json(spark, f"{path}/samples", "sample long, wer double, exact_match boolean")
    summary = files.read_json(spark, f"{path}/summary", "n_samples long, avg_wer double")
    return samples.crossJoin(F.broadcast(summary)).select("sample", _six("wer").alias("wer"), "exact_match", "n_samples", _six("avg_wer").alias("avg_wer"))


def report_row(spark, sf_dir):
    """What the console report shows, of pairs with two scores each."""
    auto = F.col("pair_id") % 7
    p = pairs(spark, sf_dir).withColumn("auto", auto).withColumn("human", F.least(F.lit(6), auto + F.when(F.col("pair_id") % 3 == 0, 1).otherwise(0)))
    r = evaluation.report_row(p, "auto", "human", "pair_id")
    return r.select(*(_six(c).alias(c) for c in ("wer", "agreement", "kappa_ratio", "mean_diff", "rmse", "max_diff", "within_10")))


def in_memory(spark, sf_dir):
    """A caller's rows and a caller's columns: one pair of each role, and its reference alone, brought to the driver from all pairs."""
    found = pairs(spark, sf_dir).groupBy("role").agg(F.min_by("hypothesis", "pair_id").alias("h"), F.min_by("reference", "pair_id").alias("r")).collect()
    rows = [{"hypothesis": x.h, "reference": x.r} for x in found] + [{"hypothesis": x.r} for x in found]
    columns = {"hypothesis": [x.role for x in found], "reference": [x.h for x in found]}
    both = files.from_rows(spark, rows).union(files.from_columns(spark, columns))
    return both.select("hypothesis", "reference", text.word_count(F.col("reference")).cast("bigint").alias("n_words"))


def word_count(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", text.word_count(F.col("text")).cast("bigint").alias("n_words"))


def resampled(spark, sf_dir):
    """Each vector as audio of 16 kHz, brought to 24 kHz."""
    waves = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<float>").alias("waveform"), F.lit(16000).alias("sample_rate"))
    to = audio.spectral(waves, gate=False, audio=audio.Audio(sample_rate=24000))
    return to.select("vec_id", F.size("waveform").cast("bigint").alias("samples"), F.round(audio.rms(F.col("waveform")), 4).alias("rms"), F.col("sample_rate").cast("bigint").alias("sample_rate"))


def truncated(spark, sf_dir):
    """The first twenty samples of each vector."""
    waves = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", audio.truncated(F.col("embedding"), audio.Audio(sample_rate=16000, longest=20 / 16000)).alias("w"))
    return waves.select("vec_id", F.size("w").cast("bigint").alias("samples"), F.round(audio.rms(F.col("w")), 5).alias("rms"))


def transcribe_files(spark, sf_dir):
    """WAV files of every vector, kept as bytes, decoded, cut into segments, recognised by a stand-in and merged; through CSV."""
    path = folder(spark)
    batches.write_large(spoken.contents(spark, sf_dir), path)
    heard = cli.transcribed(spark.read.parquet(path), spoken.load)
    back = files.read_csv(spark, _csv(heard), "file string, transcription string, confidence double")
    return back.select("file", "transcription", _six("confidence").alias("confidence"))


def recording_segments(spark, sf_dir):
    """The same sounds as blocks of a second that are rows, and the segments that are found across them."""
    path = folder(spark)
    batches.write_large(wav.blocks_of(spoken.contents(spark, sf_dir), seconds=1), path)
    found = recordings.segments(spark.read.parquet(path))
    return found.select("file", F.col("segment").cast("bigint").alias("segment"), _six("start_time").alias("start_time"), _six("end_time").alias("end_time"), F.expr(f"size(waveform) DIV {spoken.FRAME}").alias("frames"))


def compare_files(spark, sf_dir):
    """Two transcripts of all turns, in folders of seven and of three CSV files, compared row by row."""
    p = pairs(spark, sf_dir)
    one, two = (p.repartitionByRange(n, "pair_id").sortWithinPartitions("pair_id").select(F.col(c).alias("transcription")) for n, c in ((7, "reference"), (3, "hypothesis")))
    paths = [folder(spark), folder(spark)]
    for df, path in zip((one, two), paths, strict=True):
        files.write_csv(df, path, one_line=True)
    both = evaluation.compare_by_position(*(files.read_csv(spark, path, "transcription string", one_line=True) for path in paths))
    return evaluation.pairs(both).select(F.col("position").cast("bigint").alias("position"), "audio_file", _six("wer").alias("wer"), "exact_match", F.col("errors.matched").cast("bigint").alias("matched"))


def score_own_columns(spark, sf_dir):
    """The command on a table that has columns named like results: `category` is replaced, a caller's `score` and `errors` stay."""
    p = pairs(spark, sf_dir).select(*KEY, F.concat(F.lit("note "), "role").alias("category"), "hypothesis", "reference", F.concat(F.lit("human "), F.col("pair_id") % 7).alias("score"), F.col("pair_id").alias("errors"))
    out = _command(spark, "score", f"--input-csv={_csv(p)}", "--output-csv")
    schema = "conv_id long, turn long, category string, hypothesis string, reference string, score string, errors long, auto_score int, reasoning string, confidence double"
    return files.read_csv(spark, out, schema).select(*KEY, "category", "score", "errors", "auto_score", _six("confidence").alias("confidence"))


def evaluation_document(spark, sf_dir):
    """An evaluation of all pairs as one JSON document in parts, whose samples are read again."""
    # compared once, for the summary and the samples
    p = batches.kept(evaluation.pairs(pairs(spark, sf_dir)).select("pair_id", "wer", "cer", "exact_match"), 1 << 20)
    path = folder(spark)
    files.write_nested(evaluation.averages(p), p.select(F.col("pair_id").alias("sample"), "wer", "exact_match"), "samples", path)
    # the head is the first part; each line between is a sample
    lines = spark.read.text(path).where(F.col("value").rlike('^,?[{]"sample"'))
    back = lines.select(F.from_json(F.regexp_replace("value", "^,", ""), "sample long, wer double, exact_match boolean").alias("x")).select("x.*")
    return back.select("sample", _six("wer").alias("wer"), "exact_match")


QUERIES = {f"q_{f.__name__}": f for f in (csv_texts, score_command, score_batch_command, evaluate_command, validate_command, compare_raters_command, manifest_join, transcription_csv, evaluation_files, report_row, in_memory, word_count, resampled, truncated, transcribe_files, recording_segments, compare_files, score_own_columns, evaluation_document)}
