"""Transcription metrics: word and character error rates, exact matches, comparison of two transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import align, sets, text
from parlance.operators import agreement, position
from parlance.operators.naming import but, col, fresh

TARGET = 0.10


#: Columns that `pairs` adds.
OUTPUT = ("wer", "cer", "exact_match", "errors")


def pairs(df: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference") -> DataFrame:
    """Add wer, cer, exact_match and errors (five counts) to each pair; rates are null without reference. Columns of these names are replaced."""
    h, r, ht, rt = fresh(df.columns, "_h", "_r", "_ht", "_rt")
    step = df.select("*", text.lower_stripped(col(hypothesis)).alias(h), text.lower_stripped(col(reference)).alias(r))
    step = step.select("*", text.tokens(F.col(h)).alias(ht), text.tokens(F.col(r)).alias(rt))
    return step.select(
        *but(df, OUTPUT),
        align.wer(F.col(ht), F.col(rt)).alias("wer"),
        align.cer(F.col(h), F.col(r)).alias("cer"),
        (F.col(h) == F.col(r)).alias("exact_match"),
        sets.error_counts(F.col(ht), F.col(rt)).alias("errors"),
    )


def word_error_rate(df: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference", by: list[str] | None = None) -> DataFrame:
    """Errors of all pairs over the words of all references."""
    groups = by or []
    h, r, edits, words = fresh(groups, "_h", "_r", "_edits", "_words")
    t = df.select(*map(col, groups), text.lower_tokens(col(hypothesis)).alias(h), text.lower_tokens(col(reference)).alias(r))
    t = t.select(*map(col, groups), align.token_edit_distance(F.col(h), F.col(r)).alias(edits), F.size(r).alias(words))
    e, n = F.coalesce(F.sum(edits), F.lit(0)), F.coalesce(F.sum(words), F.lit(0))
    return t.groupBy(*map(col, groups)).agg(e.alias("n_errors"), n.alias("n_words"), (e / F.greatest(n, F.lit(1))).alias("wer"))


def evaluate(df: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference", target: float = TARGET, by: list[str] | None = None) -> DataFrame:
    """Mean rates of the pairs, exact-match rate and whether the target is met; zeros and false without rows."""
    return averages(pairs(df, hypothesis, reference), target, by)


def averages(measured: DataFrame, target: float = TARGET, by: list[str] | None = None) -> DataFrame:
    """`evaluate` of pairs that have `wer, cer, exact_match` already."""
    zero = F.lit(0.0)
    got = measured.groupBy(*by or []).agg(
        F.count("*").alias("n_samples"),
        F.coalesce(F.avg("wer"), zero).alias("avg_wer"),
        F.coalesce(F.avg("cer"), zero).alias("avg_cer"),
        F.coalesce(F.avg(F.col("exact_match").cast("double")), zero).alias("exact_match_rate"),
    )
    return got.withColumn("meets_target", (F.col("n_samples") > 0) & (F.col("avg_wer") <= target))


def said(df: DataFrame) -> Column:
    """`transcription`, or `hypothesis` where that is missing or empty."""
    have = [F.nullif(F.col(c), F.lit("")) for c in ("transcription", "hypothesis") if c in df.columns]
    if not have:
        raise ValueError("missing columns: transcription or hypothesis")
    return F.coalesce(*have, F.lit(""))


def compare(baseline: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Pairs of two transcripts by key: the baseline's text as reference, the test's as hypothesis.

    A key that is null, repeated or without partner is an error.
    """
    sides = baseline.select(F.col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(test.select(key, F.lit(0), F.lit(1)))
    wrong = sides.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("k IS NULL OR a <> 1 OR b <> 1").limit(5).collect()
    if wrong:
        raise ValueError("each key must be once in both: " + ", ".join(f"{r.k} is {r.a} and {r.b} times there" for r in wrong))
    return baseline.select(key, said(baseline).alias("reference")).join(test.select(key, said(test).alias("hypothesis")), key)


def compare_by_position(baseline: DataFrame, test: DataFrame) -> DataFrame:
    """Pairs of two scans of files by the place of their rows: `position, audio_file, reference, hypothesis`.

    The baseline's text is the reference, the test's the hypothesis; `audio_file` is `sample_` and the position. Both
    need the same number of rows, in however many files.
    """
    one, n = position.in_files(baseline)
    two, m = position.in_files(test)
    if n != m:
        raise ValueError(f"both need the same number of rows: {n} and {m}")
    pairs_ = one.select("position", said(one).alias("reference")).join(two.select("position", said(two).alias("hypothesis")), "position")
    return pairs_.select("position", text.sample_id(F.col("position")).alias("audio_file"), "reference", "hypothesis")


def report_row(df: DataFrame, auto: str, human: str, key: str, hypothesis: str = "hypothesis", reference: str = "reference") -> DataFrame:
    """One row with word error rate, agreement, kappa and difference statistics."""
    a, k, s = agreement.percent_agreement(df, auto, human), agreement.kappa(df, auto, human), agreement.score_difference_stats(df, auto, human, key)
    return word_error_rate(df, hypothesis, reference).select("wer").crossJoin(a).crossJoin(k).crossJoin(s)


def print_report(df: DataFrame, auto: str, human: str, key: str, **columns) -> str:
    """Print the report row as text for a console, and return it; what can't be computed is a dash."""
    r = report_row(df, auto, human, key, **columns).first()
    share = lambda x: "-" if x is None else f"{x:.1%}"
    number = lambda x, digits: "-" if x is None else f"{x:.{digits}f}"
    rows = {"Word error rate": share(r.wer), "Agreement": share(r.agreement), "Weighted kappa": number(r.kappa_ratio, 3), "Mean difference": f"{number(r.mean_diff, 1)} points", "Within 10 points": share(r.within_10)}
    said = "\n".join(["Evaluation", *(f"  {k:<18}{v}" for k, v in rows.items())])
    print(said)
    return said
