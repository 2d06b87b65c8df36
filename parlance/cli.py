"""Commands over files: transcribe, evaluate, train, create-manifest, score, validate, compare-raters, compare-transcripts, score-batch.

`transcribe` and `train` need a recogniser, which the library doesn't have:
`transcribe` takes one as MODULE:FUNCTION, which loads it (see `operators/transcripts.py`);
`train` only checks its manifests and says so.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import agreement, audio, batches, ensemble, evaluation, position, transcripts
from parlance.session import ship
from parlance.sources import files


def transcribe(spark: SparkSession, a) -> DataFrame:
    if not a.recogniser:
        raise SystemExit("transcribe needs --recogniser MODULE:FUNCTION")
    module, name = a.recogniser.split(":")
    out = transcribed(files.audio_contents(spark, a.audio_dir, "*.wav"), getattr(importlib.import_module(module), name))
    files.write_csv(out.orderBy("file"), a.output_csv)
    return out


def transcribed(contents: DataFrame, load) -> DataFrame:
    """`file, transcription, confidence` of files (`file, content`). A file that couldn't be decoded, or of which no segment could be recognised, has no confidence."""
    # decoded, gated and cut in one worker, so that no batch of whole files comes back from it
    parts = transcripts.transcribe(files.decoded(contents, then=audio.segment_frames, schema=audio.SEGMENTS), load)
    all_files = batches.kept(files.decoding_errors(contents), 1 << 16)
    out = transcripts.merge_segments(transcripts.postprocess(parts), ["file"], "start_time", "transcription", "confidence", all_files.where("error IS NULL"))
    return out.unionByName(all_files.where("error IS NOT NULL").select("file", F.lit("").alias("transcription"), F.lit(None).cast("double").alias("confidence")))


def evaluate(spark: SparkSession, a) -> DataFrame:
    df = files.read_csv(spark, a.results_csv, required=("transcription", "reference"), one_line=a.one_line)
    wer = evaluation.word_error_rate(df, "transcription").select("wer")
    same = agreement.percent_agreement(df, "transcription", "reference")
    out = wer.crossJoin(same).crossJoin(df.agg(F.count("*").alias("samples"))).withColumn("goal_wer", F.lit(evaluation.TARGET)).withColumn("meets_target", F.col("wer") <= evaluation.TARGET)
    files.write_document(out, a.output_json)
    return out


def train(spark: SparkSession, a) -> DataFrame:
    for path in (a.train_manifest, a.eval_manifest):
        files.require_columns(files.read_json(spark, path, files.MANIFEST), "audio", "reference").count()
    raise SystemExit("training a recogniser is outside this library; the manifests can be read")


def create_manifest(spark: SparkSession, a) -> DataFrame:
    out = files.manifest(files.list_audio(spark, a.input_dir))
    files.write_json(out, a.output_manifest)
    return out


def score(spark: SparkSession, a) -> DataFrame:
    df = files.read_csv(spark, a.input_csv, required=("hypothesis", "reference"), one_line=a.one_line)
    out = ensemble.scored_columns(df, a.use_ensemble)
    files.write_csv(out, a.output_csv, one_line=a.one_line)
    return out


def validate(spark: SparkSession, a) -> DataFrame:
    df = files.read_csv(spark, a.scored_csv, required=("auto_score", "human_score"), one_line=a.one_line)
    # protocols are rows that follow each other, in however many files
    df, _ = position.in_files(df.select(F.col("auto_score").cast("int"), F.col("human_score").cast("int")), "_row")
    out = agreement.report(df, "auto_score", "human_score", "_row", a.items_per_protocol)
    files.write_document(out, a.output_json)
    return out


def compare_raters(spark: SparkSession, a) -> DataFrame:
    one, two = f"{a.scorer_a}_score", f"{a.scorer_b}_score"
    df = files.read_csv(spark, a.input_csv, required=(one, two), one_line=a.one_line).select(F.col(one).cast("int").alias(one), F.col(two).cast("int").alias(two))
    metrics = agreement.item_agreement(df, one, two).select(F.struct("*").alias("metrics"))
    out = metrics.select(F.lit(f"{a.scorer_a} vs {a.scorer_b}").alias("comparison"), "metrics")
    files.write_document(out, a.output_json)
    return out


def compare_transcripts(spark: SparkSession, a) -> DataFrame:
    """Two CSV files or folders, row by row: an evaluation as one JSON document with its samples."""
    sides = [files.read_csv(spark, path, one_line=a.one_line) for path in (a.baseline_csv, a.test_csv)]
    pairs = evaluation.pairs(evaluation.compare_by_position(*sides)).orderBy("position")
    out = evaluation.evaluate(pairs).withColumn("target_wer", F.lit(evaluation.TARGET))
    files.write_nested(out, pairs.drop("position"), "samples", a.output_json)
    return out


def score_batch(spark: SparkSession, a) -> DataFrame:
    out = ensemble.score_pairs(files.read_json(spark, a.sentences_json), False).select("hypothesis", "reference", "score", "category", "reasoning", "confidence", "errors")
    files.write_array(out, a.output_json)
    agreement.score_histogram(out, "score").show()
    return out


#: No cell of the CSV spans lines: files are read in splits.
ONE_LINE = "?--one-line"

COMMANDS = {
    transcribe: ("--audio-dir", "--output-csv", "[--recogniser"),
    evaluate: ("--results-csv", "--output-json", ONE_LINE),
    train: ("--train-manifest", "--eval-manifest"),
    create_manifest: ("--input-dir", "--output-manifest"),
    score: ("--input-csv", "--output-csv", "?--use-ensemble", ONE_LINE),
    validate: ("--scored-csv", "--output-json", "#--items-per-protocol=20", ONE_LINE),
    compare_raters: ("--input-csv", "--output-json", "=--scorer-a=auto", "=--scorer-b=human", ONE_LINE),
    compare_transcripts: ("--baseline-csv", "--test-csv", "--output-json", ONE_LINE),
    score_batch: ("--sentences-json", "--output-json"),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="parlance")
    sub = top.add_subparsers(required=True)
    for f, options in COMMANDS.items():
        p = sub.add_parser(f.__name__.replace("_", "-"))
        p.set_defaults(run=f)
        for o in options:
            if o[0] == "?":
                p.add_argument(o[1:], action="store_true")
            elif o[0] == "[":
                p.add_argument(o[1:])
            elif o[0] in "#=":
                name, default = o[1:].split("=")
                p.add_argument(name, default=int(default) if o[0] == "#" else default, type=int if o[0] == "#" else str)
            else:
                p.add_argument(o, required=True)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = parser().parse_args(args)
    return a.run(ship(spark or SparkSession.builder.appName("parlance").getOrCreate()), a)


if __name__ == "__main__":
    main().show(10, truncate=False)
