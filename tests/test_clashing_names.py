"""A caller's columns stay as they are, whatever their names; equal result names are replaced once."""

import pytest

from parlance import cli
from parlance.operators import ensemble, evaluation, naming, rubric
from parlance.sources import files

NOTES = [("yo fui ayer", "yo fui ayer", "note by a rater", "human 4", "old", "mine"), ("la casa", "la casa es grande", "other", "human 1", "old", "mine")]
NAMES = "hypothesis string, reference string, category string, score string, auto_score string, errors string"


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(NOTES, NAMES)


@pytest.mark.parametrize("use_ensemble", [False, True])
def test_score_command(spark, tmp_path, notes, use_ensemble):
    files.write_csv(notes, str(tmp_path / "in"))
    cli.main(["score", "--input-csv", str(tmp_path / "in"), "--output-csv", str(tmp_path / "out"), *["--use-ensemble"] * use_ensemble], spark)
    back = files.read_csv(spark, str(tmp_path / "out"))
    # the places of pandas' assignment: equal names where they were, new ones behind
    assert back.columns == ["hypothesis", "reference", "category", "score", "auto_score", "errors", "reasoning", "confidence"]
    rows = {r.hypothesis: r for r in back.collect()}
    assert {r.score for r in rows.values()} == {"human 4", "human 1"} and {r.errors for r in rows.values()} == {"mine"}
    whole = rows["yo fui ayer"]
    assert (int(whole.auto_score), whole.category) == (6, "SIX") and rows["la casa"].category in rubric.lexicon.CATEGORIES


@pytest.mark.parametrize("apply", [rubric.apply, ensemble.apply])
def test_working_names(spark, apply):
    """Inputs named like the working columns, in any case, and a text column named like a result."""
    odd = ["_h", "_R", "_hc", "_score", "_final_score", "_lh", "Penalty", "rule_score", "a.b", "a`b"]
    df = spark.createDataFrame([("yo fui", "yo fui ayer", *odd)], ["score", "errors", *odd])
    out = apply(df, "score", "errors")
    plain = apply(spark.createDataFrame([("yo fui", "yo fui ayer")], ["h", "r"]), "h", "r").first()
    row = out.first().asDict()
    assert len(out.columns) == len({c.lower() for c in out.columns})
    assert row["score"] == plain.score and row["errors"] == plain.errors and row["penalty"] == plain.penalty
    kept = [n for n in odd if n not in ("Penalty", "rule_score")]
    assert all(row[n] == n for n in kept)


def test_evaluation(spark):
    df = spark.createDataFrame([("a b", "a c", 9, 8, 7, "x"), ("a", "a", 9, 8, 7, "x")], "hypothesis string, reference string, wer int, _h int, _words int, errors string")
    rows = sorted(evaluation.pairs(df).collect(), key=lambda r: r.wer)
    assert [(r.wer, r._h, r._words, r.errors.ref_tokens) for r in rows] == [(0.0, 8, 7, 1), (0.5, 8, 7, 2)]
    assert evaluation.evaluate(df).first().avg_wer == 0.25
    assert evaluation.word_error_rate(df, by=["_words"]).first().wer == 1 / 3


def test_replaced(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["A", "b", "c"])
    out = df.select(*naming.replaced(df.columns, {"a": naming.col("c") * 10, "d": naming.col("b")}))
    assert out.columns == ["a", "b", "c", "d"] and tuple(out.first()) == (30, 2, 3, 2)
    assert naming.fresh(["X", "x_"], "x", "x", "y") == ["x__", "x___", "y"]
