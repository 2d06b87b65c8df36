"""The 0-6 rubric: error lists, penalty, score ladder, confidence and reasoning, as one projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import lexicon, sets, text
from parlance.operators.naming import but, col, fresh

MAX_SCORE = 6
LOST, OMITTED, ADDED = "Missing content word", "Omission", "Addition"


@dataclass(frozen=True)
class Rubric:
    """Penalties of one error of each kind, and the content overlaps below which a score is 0 or 1."""

    structural: int = 2
    lexical: int = 1
    omission: int = 1
    addition: int = 1
    nothing: float = 0.15
    little: float = 0.35


def _verb_group() -> Column:
    return F.create_map(*(F.lit(x) for g, forms in enumerate(lexicon.VERB_FORMS) for f in forms.split() for x in (f, g)))


def category_of(score: Column) -> Column:
    return F.element_at(text.strings(lexicon.CATEGORIES), score + 1)


def length_errors(h: Column, r: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.size(h) < 0.5 * F.size(r), text.strings([lexicon.MAJOR_DELETION])).when(F.size(h) > 1.5 * F.size(r), text.strings([lexicon.MAJOR_INSERTION])).otherwise(none)


def conjugations(h: Column, r: Column) -> Column:
    """`a, b` words at the same place that are different forms of one verb."""
    group, forms = _verb_group(), " ".join(lexicon.VERB_FORMS).split()

    def at(a: Column, b: Column) -> Column:
        # few words are forms of these verbs: the hashed test comes first
        return F.when(a.isin(forms) & b.isin(forms) & (a != b) & (F.try_element_at(group, a) == F.try_element_at(group, b)), F.struct(a.alias("a"), b.alias("b")))

    return F.filter(F.zip_with(h, r, at), lambda x: x.isNotNull())


def conjugation_errors(h: Column, r: Column) -> Column:
    return _conjugations_named(conjugations(h, r))


def _conjugations_named(pairs: Column) -> Column:
    return F.transform(pairs, lambda x: F.concat(F.lit("Conjugation: '"), x["a"], F.lit("' vs '"), x["b"], F.lit("'")))


def _named(words: Column, kind: str) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(f"{kind}: '"), w, F.lit("'")))


def verbs_of(words: Column) -> Column:
    """The different verbs that words are forms of."""
    group, forms = _verb_group(), " ".join(lexicon.VERB_FORMS).split()
    return F.array_distinct(F.transform(F.filter(words, lambda x: x.isin(forms)), lambda x: F.try_element_at(group, x)))


def lost_words(hc: Column, rc: Column, verbs: Column) -> Column:
    """Different content words of the reference without the word or another form of its verb (`verbs` of hc), in order of appearance."""
    group = _verb_group()
    return F.filter(F.array_except(rc, hc), lambda w: ~F.coalesce(F.array_contains(verbs, F.try_element_at(group, w)), F.lit(False)))


def _among(words: Column, these: Column) -> Column:
    """Words, repeated ones kept, that are among these."""
    return F.filter(words, lambda w: F.array_contains(these, w))


def lexical_errors(hc: Column, rc: Column) -> Column:
    return _named(text.let(verbs_of(hc), lambda verbs: lost_words(hc, rc, verbs)), LOST)


def omissions(h: Column, rc: Column) -> Column:
    return _named(text.let(F.array_except(rc, h), lambda these: _among(rc, these)), OMITTED)


def additions(hc: Column, r: Column) -> Column:
    return _named(text.let(F.array_except(hc, r), lambda these: _among(hc, these)), ADDED)


def ladder(overlap: Column, content: Column, penalty: Column, rubric: Rubric = Rubric()) -> Column:
    steps = F.when(content < rubric.nothing, 0).when(content < rubric.little, 1)
    steps = reduce(lambda c, s: c.when((overlap >= s[1]) & (F.lit(True) if s[2] is None else penalty <= s[2]), s[0]), lexicon.LADDER, steps)
    return steps.otherwise(1)


def confidence(overlap: Column) -> Column:
    near = F.array_min(F.transform(F.array(*map(F.lit, lexicon.OVERLAP_STEPS)), lambda t: F.abs(overlap - t)))
    return F.when(overlap.isin(0.0, 1.0), 1.0).otherwise(F.least(F.lit(1.0), 0.5 + 2 * near))


def percent(x: Column) -> Column:
    """One decimal, ties to the even digit."""
    return F.format_string("%.1f%%", F.bround(x * 100, 1))


def reasoning(score: Column, overlap: Column, content: Column, *errors: Column) -> Column:
    names = ("Structural errors", "Lexical errors", "Omissions", "Additions")
    first = [F.when(F.size(e) > 0, F.concat(F.lit(f"{n} ("), F.size(e).cast("string"), F.lit("): "), F.array_join(F.slice(e, 1, 3), ", "), F.lit("."))) for n, e in zip(names, errors, strict=True)]
    none = F.when(sum((F.size(e) for e in errors), F.lit(0)) == 0, "No significant errors detected.")
    return F.concat_ws(" ", F.concat(F.lit("Score: "), score.cast("string"), F.lit(f"/{MAX_SCORE}.")), F.concat(F.lit("Token overlap: "), percent(overlap), F.lit(", content overlap: "), percent(content), F.lit(".")), *first, none)


#: Columns that `apply` adds.
OUTPUT = ("score", "max_score", "category", "errors", "reasoning", "confidence", "penalty", "token_overlap", "content_overlap", "normalized_score", "is_perfect", "is_zero")


def decided(df: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference", rubric: Rubric = Rubric()) -> tuple[DataFrame, dict[str, Column]]:
    """`df` with working columns whose names it doesn't have, and the rubric's OUTPUT as columns of that."""
    every = ("h", "r", "hc", "rc", "overlap", "content", "length", "pairs", "lost", "omitted", "added", "penalty", "score", "structural", "lexical", "omissions", "additions")
    name = dict(zip(every, fresh(df.columns, *(f"_{n}" for n in every)), strict=True))
    c = {n: F.col(x) for n, x in name.items()}

    def more(step: DataFrame, **columns: Column) -> DataFrame:
        return step.select("*", *(x.alias(name[n]) for n, x in columns.items()))

    step = more(df, h=text.tokens(text.normalized(col(hypothesis))), r=text.tokens(text.normalized(col(reference))))
    step = more(step, hc=text.content_words(c["h"]), rc=text.content_words(c["r"]))
    step = more(step, overlap=sets.token_overlap(c["h"], c["r"]), content=sets.content_overlap(c["hc"], c["rc"]), length=length_errors(c["h"], c["r"]), pairs=conjugations(c["h"], c["r"]))
    # a column used once would be put back into the lambda, and computed for each word: `let` keeps it outside
    lost = text.let(verbs_of(c["hc"]), lambda verbs: lost_words(c["hc"], c["rc"], verbs))
    omitted = text.let(F.array_except(c["rc"], c["h"]), lambda these: _among(c["rc"], these))
    added = text.let(F.array_except(c["hc"], c["r"]), lambda these: _among(c["hc"], these))
    step = more(step, lost=lost, omitted=omitted, added=added)
    silent = F.size(c["h"]) == 0
    counts = (F.size(c["length"]) + F.size(c["pairs"]), F.size(c["lost"]), F.size(c["omitted"]), F.size(c["added"]))
    weight = (rubric.structural, rubric.lexical, rubric.omission, rubric.addition)
    step = more(step, penalty=F.when(silent, None).otherwise(sum((n * w for n, w in zip(counts, weight, strict=True)), F.lit(0))))
    step = more(step, score=F.when(silent, 0).otherwise(ladder(c["overlap"], c["content"], c["penalty"], rubric)))
    # the texts come last: a query of scores alone builds none
    step = more(step, structural=F.concat(c["length"], _conjugations_named(c["pairs"])), lexical=_named(c["lost"], LOST), omissions=_named(c["omitted"], OMITTED), additions=_named(c["added"], ADDED))
    kinds = [c[k] for k in ("structural", "lexical", "omissions", "additions")]
    return step, {
        "score": c["score"],
        "max_score": F.lit(MAX_SCORE),
        "category": category_of(c["score"]),
        "errors": F.when(silent, F.array().cast("array<string>")).otherwise(F.concat(*kinds)),
        "reasoning": F.when(silent, lexicon.EMPTY_REASON).otherwise(reasoning(c["score"], c["overlap"], c["content"], *kinds)),
        "confidence": F.when(silent, 1.0).otherwise(confidence(c["overlap"])),
        "penalty": c["penalty"],
        "token_overlap": c["overlap"],
        "content_overlap": c["content"],
        "normalized_score": normalized_score(c["score"], F.lit(MAX_SCORE)),
        "is_perfect": c["score"] == MAX_SCORE,
        "is_zero": c["score"] == 0,
    }


def apply(df: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference", rubric: Rubric = Rubric()) -> DataFrame:
    """Add the rubric's columns to each pair; null texts are empty. No shuffle, no Python.

    A column of `df` that is named like one of OUTPUT is replaced; any other stays as it is.
    """
    step, out = decided(df, hypothesis, reference, rubric)
    return step.select(*but(df, OUTPUT), *(x.alias(n) for n, x in out.items()))


def normalized_score(score: Column, most: Column) -> Column:
    return F.when(most > 0, score / F.greatest(most, F.lit(1))).otherwise(0.0)
