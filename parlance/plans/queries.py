"""Registered queries, one or more for each operator family, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import align, lexicon, sets, text
from parlance.operators import agreement, audio, ensemble, evaluation, position, rubric, transcripts
from parlance.plans.derive import pairs, ratings
from parlance.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = ("conv_id", "turn")


def query(f: Query) -> Query:
    QUERIES[f"q_{f.__name__}"] = f
    return f


def _six(c) -> F.Column:
    return F.round(c, 6)


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    p = p.withColumn("h", text.tokens(text.normalized(F.col("hypothesis")))).withColumn("r", text.tokens(text.normalized(F.col("reference"))))
    return p.withColumn("hc", text.content_words(F.col("h"))).withColumn("rc", text.content_words(F.col("r")))


@query
def normalize_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select(*KEY, F.array_join("r", " ").alias("normalized"), F.size("r").cast("bigint").alias("n_tokens"))


@query
def content_words(spark, sf_dir):
    low = text.lower_tokens(F.col("reference"))
    return _tokens(spark, sf_dir).select(*KEY, F.array_join("rc", " ").alias("content"), F.array_join(text.content_words(low, lexicon.ENSEMBLE_STOP_WORDS), " ").alias("ensemble_content"))


@query
def overlaps(spark, sf_dir):
    t = _tokens(spark, sf_dir).withColumn("lh", text.lower_tokens(F.col("hypothesis"))).withColumn("lr", text.lower_tokens(F.col("reference")))
    stop = lexicon.ENSEMBLE_STOP_WORDS
    return t.select(
        *KEY,
        _six(sets.token_overlap(F.col("h"), F.col("r"))).alias("token_overlap"),
        _six(sets.content_overlap(F.col("hc"), F.col("rc"))).alias("content_overlap"),
        _six(sets.jaccard(F.col("lh"), F.col("lr"))).alias("jaccard"),
        _six(sets.content_overlap(text.content_words(F.col("lh"), stop), text.content_words(F.col("lr"), stop))).alias("semantic"),
    )


@query
def error_counts(spark, sf_dir):
    h, r, hc, rc = map(F.col, ("h", "r", "hc", "rc"))
    t = _tokens(spark, sf_dir).withColumn("e", sets.error_counts(h, r))
    n = {"n_length": rubric.length_errors(h, r), "n_lexical": rubric.lexical_errors(hc, rc), "n_omissions": rubric.omissions(h, rc), "n_additions": rubric.additions(hc, r)}
    return t.select(*KEY, *(F.size(c).cast("bigint").alias(k) for k, c in n.items()), *(F.col(f"e.{k}").cast("bigint").alias(k) for k in ("ref_tokens", "hyp_tokens", "matched", "deletions", "insertions")))


@query
def errors(spark, sf_dir):
    return rubric.apply(pairs(spark, sf_dir)).select(*KEY, F.array_join(F.array_sort("errors"), "; ").alias("errors"))


@query
def error_frequency(spark, sf_dir):
    return agreement.error_frequency(rubric.apply(pairs(spark, sf_dir)))


@query
def error_share(spark, sf_dir):
    return agreement.error_share(rubric.apply(pairs(spark, sf_dir))).select("n", "n_with_errors", _six("with_errors").alias("with_errors"), _six("without_errors").alias("without_errors"))


@query
def rubric_score(spark, sf_dir):
    s = rubric.apply(pairs(spark, sf_dir))
    return s.select(*KEY, "score", "category", F.coalesce("penalty", F.lit(0)).cast("bigint").alias("penalty"), _six("confidence").alias("confidence"), _six("normalized_score").alias("normalized_score"), "is_perfect", "is_zero")


@query
def rubric_reasoning(spark, sf_dir):
    return rubric.apply(pairs(spark, sf_dir)).select(*KEY, "score", "reasoning")


@query
def conjugation(spark, sf_dir):
    """Reference words whose verb group the next word of the fixed list shares, as a conjugation slip at the same place."""
    forms = " ".join(lexicon.VERB_FORMS).split()
    t = pairs(spark, sf_dir).select(*KEY, "pair_id", text.tokens(text.normalized(F.col("reference"))).alias("t"))
    words = text.strings(forms)
    k = F.col("pair_id")
    h = F.transform("t", lambda x, i: F.element_at(words, ((k + i) % len(forms) + 1).cast("int")))
    r = F.transform("t", lambda x, i: F.element_at(words, ((k * 3 + i * 2) % len(forms) + 1).cast("int")))
    return t.select(*KEY, F.array_join(rubric.conjugation_errors(h, r), "; ").alias("errors"))


@query
def ensemble_score(spark, sf_dir):
    s = ensemble.apply(pairs(spark, sf_dir))
    return s.select(*KEY, "rule_score", _six("rule_confidence").alias("rule_confidence"), "score", _six("confidence").alias("confidence"), "category", "final_category")


@query
def token_edit_distance(spark, sf_dir):
    return _tokens(spark, sf_dir).select(*KEY, align.token_edit_distance(F.col("h"), F.col("r")).cast("bigint").alias("distance"))


@query
def lcs_length(spark, sf_dir):
    return _tokens(spark, sf_dir).select(*KEY, align.lcs_length(F.col("h"), F.col("r")).cast("bigint").alias("lcs"))


@query
def wer_micro(spark, sf_dir):
    return evaluation.word_error_rate(pairs(spark, sf_dir), by=["role"]).withColumn("wer", _six("wer"))


@query
def wer_macro(spark, sf_dir):
    e = evaluation.evaluate(pairs(spark, sf_dir), by=["role"])
    return e.select("role", "n_samples", _six("avg_wer").alias("avg_wer"), _six("exact_match_rate").alias("exact_match_rate"), "meets_target")


@query
def pair_wer(spark, sf_dir):
    return evaluation.pairs(pairs(spark, sf_dir)).select(*KEY, _six("wer").alias("wer"), "exact_match")


@query
def pair_cer(spark, sf_dir):
    """Character error rates of each pair."""
    return evaluation.pairs(pairs(spark, sf_dir)).select(*KEY, _six("cer").alias("cer"))


@query
def percent_agreement(spark, sf_dir):
    return agreement.percent_agreement(pairs(spark, sf_dir), "hypothesis", "reference", ["role"]).withColumn("agreement", _six("agreement"))


@query
def item_agreement(spark, sf_dir):
    i = agreement.item_agreement(ratings(spark, sf_dir), "auto", "human")
    return i.select(*(_six(c).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) for c, t in i.dtypes))


@query
def kappa(spark, sf_dir):
    k = agreement.kappa(ratings(spark, sf_dir), "auto", "human", by=["user_id"])
    return k.select("user_id", _six("kappa_ratio").alias("kappa_ratio"), _six("kappa").alias("kappa"))


@query
def label_kappa(spark, sf_dir):
    k = agreement.kappa(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", "toxic", 1)
    return k.select(_six("kappa_ratio").alias("kappa_ratio"), _six("kappa").alias("kappa"))


@query
def protocol_agreement(spark, sf_dir):
    p = agreement.protocol_agreement(ratings(spark, sf_dir), "auto", "human", "event_id")
    return p.select(*(_six(c).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) for c, t in p.dtypes))


@query
def score_difference_stats(spark, sf_dir):
    p = agreement.score_difference_stats(ratings(spark, sf_dir), "auto", "human", "event_id")
    return p.select(*(_six(c).alias(c) if t == "double" else F.col(c) for c, t in p.dtypes))


@query
def confusion_matrix(spark, sf_dir):
    return agreement.confusion_matrix(ratings(spark, sf_dir), "human", "auto", list(range(7)))


@query
def confusion_matrix_found_labels(spark, sf_dir):
    return agreement.confusion_matrix(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", "quality")


@query
def score_histogram(spark, sf_dir):
    return agreement.score_histogram(rubric.apply(pairs(spark, sf_dir)), "score").withColumn("percent", _six("percent"))


@query
def score_value_counts(spark, sf_dir):
    return agreement.value_counts(rubric.apply(pairs(spark, sf_dir)), "score")


@query
def score_statistics(spark, sf_dir):
    d = agreement.describe(rubric.apply(pairs(spark, sf_dir)), "score", ["role"])
    return d.select("role", *(_six(c).alias(c) for c in ("mean", "median", "std")), "min", "max")


@query
def confidence_split(spark, sf_dir):
    c = agreement.confidence_split(rubric.apply(pairs(spark, sf_dir)))
    return c.select("n_high", "n_low", _six("high").alias("high"), _six("low").alias("low"))


@query
def report_summary(spark, sf_dir):
    r = agreement.report(ratings(spark, sf_dir), "auto", "human", "event_id")
    return r.select(_six("item_level.exact").alias("exact"), "summary.meets_goal", _six("summary.protocol_accuracy").alias("protocol_accuracy"))


@query
def top_disagreements(spark, sf_dir):
    """A report of the ten largest disagreements."""
    return agreement.top_disagreements(ratings(spark, sf_dir), "auto", "human", "event_id").select("event_id", F.col("auto").cast("bigint"), F.col("human").cast("bigint"), F.col("diff").cast("bigint"))


@query
def outliers(spark, sf_dir):
    return agreement.outliers(ratings(spark, sf_dir), "auto", "human").select("event_id", F.col("diff").cast("bigint"))


@query
def compare_transcripts(spark, sf_dir):
    p = pairs(spark, sf_dir)
    base = p.select("pair_id", F.col("reference").alias("transcription"))
    test = p.select("pair_id", F.col("hypothesis").alias("transcription"), F.lit("-").alias("hypothesis"))
    c = evaluation.evaluate(evaluation.compare(base, test, "pair_id"))
    return c.select("n_samples", _six("avg_wer").alias("avg_wer"), _six("exact_match_rate").alias("exact_match_rate"))


@query
def postprocess(spark, sf_dir):
    said = F.concat(F.lit("Um, "), F.col("reference"), F.lit(" — este [ruido] fui... aber (risas) esta casa graned."))
    return pairs(spark, sf_dir).select(*KEY, text.postprocessed(said).alias("text"))


@query
def explain_diff(spark, sf_dir):
    e = text.explained(F.col("hypothesis"), F.lower("reference"))
    return pairs(spark, sf_dir).withColumn("e", e).select(*KEY, *(F.array_join(f"e.{k}", " ").alias(k) for k in ("removed", "added", "unchanged")))


@query
def merge_segments(spark, sf_dir):
    merged = transcripts.merge_segments(rubric.apply(pairs(spark, sf_dir)), ["conv_id"], "turn", "hypothesis", "confidence")
    return merged.select("conv_id", F.trim("transcription").alias("transcription"), _six("confidence").alias("confidence"))


@query
def sample_ids(spark, sf_dir):
    return position.numbered(ratings(spark, sf_dir).select("event_id"), "event_id").select("event_id", text.sample_id(F.col("position")).alias("sample_id"))


@query
def frequent_labels(spark, sf_dir):
    """Users that have at least one in a hundred of all events and labels of users, from a summary and one count."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.col("user_id") % 40).alias("group"))
    return agreement.frequent_labels(events, "user_id", "group", share=0.01).select("label", "n")


@query
def value_quantiles(spark, sf_dir):
    """Quantiles of the values of each type of event, from summaries, held against the exact ranks: the error is within its bound."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value")
    found = agreement.quantiles(events, "value", [0.1, 0.25, 0.5, 0.75, 0.9], ["event_type"], error=0.01)
    rank = events.where("value IS NOT NULL").join(found.withColumnRenamed("value", "q"), "event_type")
    shares = rank.groupBy("event_type", "probability").agg(F.count("*").alias("n"), F.avg((F.col("value") < F.col("q")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("q")).cast("double")).alias("up_to"))
    # of few values, the nearest ones lie further apart than the bound
    slack = 0.01 + 1 / F.col("n")
    return shares.select("event_type", "probability", "n", ((F.col("below") <= F.col("probability") + slack) & (F.col("up_to") >= F.col("probability") - slack)).alias("within"))


@query
def event_segments(spark, sf_dir):
    """Runs of each user's events with a value above 50, split by three quieter ones."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = audio.frame_segments(events, ["user_id"], "event_id", F.coalesce(F.col("value") > 50, F.lit(False)), 3)
    return s.select("user_id", F.col("start_frame").cast("bigint").alias("start_frame"), "end_frame", "tail")


def _waves(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("waveform"))


@query
def usable_segments(spark, sf_dir):
    """Event segments of 2 to 30 events."""
    s = event_segments(spark, sf_dir).withColumnsRenamed({"start_frame": "start_time", "end_frame": "end_time"})
    return audio.usable(s, audio.Audio(shortest=2, longest=30)).select("user_id", "start_time", audio.duration().alias("duration"))


@query
def mean_log_prob(spark, sf_dir):
    """Each vector's mean, as that of token log-probabilities."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(transcripts.mean_log_prob("embedding"), 6).alias("confidence"))


@query
def mono(spark, sf_dir):
    """The mean of each vector and its reverse as two channels."""
    m = audio.mono(F.col("waveform"), F.reverse("waveform"))
    return _waves(spark, sf_dir).withColumn("m", m).select("vec_id", F.size("m").cast("bigint").alias("samples"), F.round(F.array_max("m").cast("double"), 5).alias("peak"))


@query
def manifest(spark, sf_dir):
    """A manifest row for every page."""
    return files.manifest(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("file")))


@query
def rms_normalize(spark, sf_dir):
    w = _waves(spark, sf_dir).withColumn("waveform", audio.normalized(F.col("waveform")))
    return w.select("vec_id", F.round(audio.rms(F.col("waveform")), 5).alias("rms"), F.round(F.array_max("waveform"), 5).alias("peak"))


@query
def waveform_segments(spark, sf_dir):
    """Segments of each vector as audio of frames of four samples, then trimmed."""
    s = audio.segments(_waves(spark, sf_dir), frame=4, min_silence=2, threshold=0.13)
    s = audio.trimmed(s, frame=4, threshold=0.13)
    return s.select("vec_id", F.col("segment").cast("bigint").alias("segment"), _six(F.col("start_time") * 16000).alias("start"), _six(F.col("end_time") * 16000).alias("end"), F.size("waveform").cast("bigint").alias("samples"))


@query
def score_by_role(spark, sf_dir):
    """The flagship: rubric scores of every turn, by role."""
    s = rubric.apply(pairs(spark, sf_dir))
    return s.groupBy("role").agg(F.count("*").alias("n"), _six(F.avg("score")).alias("mean_score"), _six(F.avg("confidence")).alias("mean_confidence"), F.count_if("is_perfect").alias("n_perfect"))
