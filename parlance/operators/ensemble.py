"""The heuristic ensemble for uncertain pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import align, lexicon, sets, text
from parlance.operators import rubric
from parlance.operators.naming import but, col, fresh, replaced

#: Confidence from which the rule's score stands; weights of the rule and of each heuristic.
SURE, RULE, HEURISTIC = 0.85, 0.4, 0.2


def heuristics(h: Column, r: Column) -> list[Column]:
    """Jaccard, subsequence and content similarity of lower-case tokens."""
    stop = lexicon.ENSEMBLE_STOP_WORDS
    return [sets.jaccard(h, r), align.subsequence(h, r), sets.content_overlap(text.content_words(h, stop), text.content_words(r, stop))]


def predict(h: Column, r: Column, score: Column, confidence: Column, most: int = rubric.MAX_SCORE) -> tuple[Column, Column]:
    """(score, confidence) from lower-case tokens and the rule: the rule's where it is sure, else a weighted mean, ties to even."""
    # the order of the sum decides ties that floating point only just makes or misses
    parts = [(sets.scaled(v, most), F.lit(HEURISTIC)) for v in heuristics(h, r)] + [(score, RULE * confidence)]
    mean = sum((v * w for v, w in parts), F.lit(0.0)) / sum((w for _, w in parts), F.lit(0.0))
    sure = confidence >= SURE
    return F.when(sure, score).otherwise(F.bround(mean).cast("int")), F.when(sure, confidence).otherwise(0.5 * confidence + 0.5)


#: Columns that `apply` adds.
OUTPUT = (*rubric.OUTPUT, "rule_score", "rule_confidence", "final_category")


def decided(df: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference", config: rubric.Rubric = rubric.Rubric()) -> tuple[DataFrame, dict[str, Column]]:
    """As `rubric.decided`, with the ensemble's OUTPUT."""
    step, ruled = rubric.decided(df, hypothesis, reference, config)
    h, r, score, sure = fresh(step.columns, "_lh", "_lr", "_rule_score", "_rule_confidence")
    step = step.select("*", text.lower_tokens(col(hypothesis)).alias(h), text.lower_tokens(col(reference)).alias(r), ruled["score"].alias(score), ruled["confidence"].alias(sure))
    final, confidence = fresh(step.columns, "_final_score", "_final_confidence")
    a, b = predict(F.col(h), F.col(r), F.col(score), F.col(sure))
    step = step.select("*", a.alias(final), b.alias(confidence))
    more = {"rule_score": F.col(score), "rule_confidence": F.col(sure), "score": F.col(final), "confidence": F.col(confidence), "final_category": rubric.category_of(F.col(final))}
    return step, {**{n: c for n, c in ruled.items() if n not in more}, **more}


def apply(df: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference", config: rubric.Rubric = rubric.Rubric()) -> DataFrame:
    """Rubric and ensemble: `score` and `confidence` are final; `category`, `errors` and `reasoning` stay the rule's, `final_category` is the final score's.

    A column of `df` that is named like one of OUTPUT is replaced; any other stays as it is.
    """
    step, out = decided(df, hypothesis, reference, config)
    return step.select(*but(df, OUTPUT), *(x.alias(n) for n, x in out.items()))


def score_pairs(df: DataFrame, use_ensemble: bool = True, **columns) -> DataFrame:
    return apply(df, **columns) if use_ensemble else rubric.apply(df, **columns)


def scored_columns(df: DataFrame, use_ensemble: bool = False, **columns) -> DataFrame:
    """The columns of `df` as they are, with `auto_score`, `reasoning`, `confidence` and `category`, each of which replaces a column of its name."""
    step, out = (decided if use_ensemble else rubric.decided)(df, **columns)
    return step.select(*replaced(df.columns, {"auto_score": out["score"], **{n: out[n] for n in ("reasoning", "confidence", "category")}}))
