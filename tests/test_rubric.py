"""The rubric and the ensemble against known values and against a plain Python version."""

import math

import numpy as np
import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st

from parlance.functions import lexicon
from parlance.functions.align import lcs_of
from parlance.operators import agreement, ensemble, rubric
from parlance.sources import files

# Hypothesis, reference, human score, rule score, penalty, confidence, ensemble score.
GOLDEN = [
    ("yo fui al mercado ayer", "yo fui al mercado ayer", 6, 0, 1.0, 6),
    ("yo fui al mercado", "yo fui al mercado ayer", 4, 2, 0.5, 5),
    ("fui mercado", "yo fui al mercado ayer", 2, 6, 0.5, 2),
    ("mi hermana estudia en la universidad", "mi hermana estudia en la universidad", 6, 0, 1.0, 6),
    ("mi hermana estudia", "mi hermana estudia en la universidad", 2, 2, 0.7, 3),
]


def plain(hyp: str, ref: str) -> tuple[int, float, list[str], int]:
    """Score, confidence, errors and ensemble score, a word at a time."""

    def norm(s):
        return "".join(c for c in s.lower() if c.isalnum() or c in "_" or c.isspace()).split()

    h, r = norm(hyp or ""), norm(ref or "")
    if not h:
        return 0, 1.0, [], 0
    group = {w: g for g, forms in enumerate(lexicon.VERB_FORMS) for w in forms.split()}
    hc, rc = ([w for w in x if w not in lexicon.FUNCTION_WORDS] for x in (h, r))
    overlap = len({*h} & {*r}) / len({*r}) if r else 0.0
    content = len({*hc} & {*rc}) / len(rc) if rc else 1.0
    structural = []
    if len(h) < 0.5 * len(r):
        structural.append(lexicon.MAJOR_DELETION)
    elif len(h) > 1.5 * len(r):
        structural.append(lexicon.MAJOR_INSERTION)
    structural += [f"Conjugation: '{a}' vs '{b}'" for a, b in zip(h, r, strict=False) if a != b and a in group and group.get(a) == group.get(b)]
    lexical = [f"Missing content word: '{w}'" for w in dict.fromkeys(rc) if w not in hc and not any(w in group and group.get(x) == group[w] for x in hc)]
    omitted = [f"Omission: '{w}'" for w in rc if w not in h]
    added = [f"Addition: '{w}'" for w in hc if w not in r]
    penalty = 2 * len(structural) + len(lexical) + len(omitted) + len(added)
    if content < 0.15:
        score = 0
    elif content < 0.35:
        score = 1
    else:
        score = next((s for s, least, most in lexicon.LADDER if overlap >= least and (most is None or penalty <= most)), 1)
    sure = 1.0 if overlap in (0, 1) else min(1.0, 0.5 + 2 * min(abs(overlap - t) for t in lexicon.OVERLAP_STEPS))
    final = score
    if sure < 0.85:
        h, r = (hyp or "").lower().split(), (ref or "").lower().split()
        hc, rc = ([w for w in x if w not in lexicon.ENSEMBLE_STOP_WORDS] for x in (h, r))
        parts = [len({*h} & {*r}) / max(len({*h} | {*r}), 1) if r else 0.0, lcs_of(h, r) / max(len(h), len(r), 1), len({*hc} & {*rc}) / len(rc) if rc else 1.0]
        final = round(np.average([*(p * 6 for p in parts), score], weights=[0.2, 0.2, 0.2, 0.4 * sure]))
    return score, sure, structural + lexical + omitted + added, final


def test_golden(spark):
    df = spark.createDataFrame([(i, *g[:2]) for i, g in enumerate(GOLDEN)], "i int, hypothesis string, reference string")
    rows = ensemble.apply(df).orderBy("i").collect()
    for row, (_, _, score, penalty, sure, final) in zip(rows, GOLDEN, strict=True):
        assert (row.rule_score, row.penalty, row.score) == (score, penalty, final)
        assert row.rule_confidence == pytest.approx(sure)


CASES = [
    ("   ", "hola", 0), (None, "hola", 0), ("hola", "", 1), ("hola", None, 1), ("el la", "el la", 6), ("pan pan", "pan pan", 6),
    ("esta", "está", None), ("¡Yo, FUI!", "yo fui", 6), ("yo fue", "yo fui", None), ("a\nb", "a b", 6), ("uno dos tres", "uno dos tres cuatro cinco seis", None),
]


def test_adversarial(spark):
    df = spark.createDataFrame([(i, h, r) for i, (h, r, _) in enumerate(CASES)], "i int, hypothesis string, reference string")
    rows = ensemble.apply(df).orderBy("i").collect()
    for row, (h, r, score) in zip(rows, CASES, strict=True):
        expected = plain(h, r)
        assert (row.rule_score, pytest.approx(row.rule_confidence), row.errors, row.score) == expected, (h, r)
        if score is not None:
            assert row.rule_score == score
        assert row.category == lexicon.CATEGORIES[row.rule_score] and row.final_category == lexicon.CATEGORIES[row.score]
    conjugated = rows[8]
    assert conjugated.errors == ["Conjugation: 'fue' vs 'fui'", "Omission: 'fui'", "Addition: 'fue'"] and conjugated.penalty == 4
    assert rows[0].reasoning == lexicon.EMPTY_REASON and rows[0].errors == []


WORDS = ["yo", "fui", "fue", "el", "la", "pan", "mercado", "ayer", "está", "estoy", "casa", "grande", "no", "sí", "María"]
SENTENCE = st.lists(st.sampled_from(WORDS), max_size=9).map(" ".join)


@settings(max_examples=3, deadline=None, derandomize=True, phases=[Phase.generate])
@given(st.lists(st.tuples(SENTENCE, SENTENCE), min_size=40, max_size=60))
def test_same_as_plain_version(spark, pairs):
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "i int, hypothesis string, reference string")
    for row, (h, r) in zip(ensemble.apply(df).orderBy("i").collect(), pairs, strict=True):
        assert (row.rule_score, pytest.approx(row.rule_confidence), row.errors, row.score) == plain(h, r), (h, r)
        assert 0 <= row.rule_score <= 6 and 0.5 <= row.confidence <= 1


def test_reasoning_rounds_ties_to_even(spark):
    row = rubric.apply(files.from_rows(spark, [{"hypothesis": "uno dos tres cuatro cinco", "reference": "uno dos tres cuatro cinco a1 a2 a3 a4 a5 a6 a7 a8 a9 b1 b2"}])).first()
    assert "Token overlap: 31.2%" in row.reasoning and row.reasoning.startswith("Score: 1/6.")
    assert "Omissions (11): Omission: 'a1', Omission: 'a2', Omission: 'a3'." in row.reasoning


def test_columns_that_clash(spark):
    df = spark.createDataFrame([("a", "a", 9, "x", 1)], "hypothesis string, reference string, score int, errors string, `odd.name` int")
    out = rubric.apply(df)
    assert out.columns.count("score") == 1 and out.first().score == 6 and out.first()["odd.name"] == 1


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = rubric.apply(spark.createDataFrame([("a", "b")], files.PAIRS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_empty_table(spark):
    scored = rubric.apply(spark.createDataFrame([], files.PAIRS))
    assert scored.count() == 0
    assert [r.n for r in agreement.score_histogram(scored, "score").orderBy("score").collect()] == [0] * 7
    assert math.isclose(agreement.error_share(scored).first().n, 0)
