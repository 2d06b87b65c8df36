"""The functions as SQL: temporary functions that inline into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from parlance.functions import align, lexicon


def _list(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def register(spark: SparkSession) -> list[str]:
    """Create the SQL functions in the session; returns their names."""
    first, gap = align.FIRST + 1, f"c + CASE WHEN c >= {align.SURROGATES} THEN {align.GAP} ELSE 0 END"
    place = "aggregate(steps, 0, (a, s) -> CASE WHEN get(w, a + s - 1) <= x THEN a + s ELSE a END, a -> CASE WHEN get(w, a - 1) = x THEN a ELSE 0 END)"
    spell = f"decode(unhex(array_join(transform(transform({{t}}, x -> CASE WHEN size(w) <= {align.FEW} THEN {{few}} ELSE CAST({{many}} AS BIGINT) END), c -> lpad(hex({gap}), 8, '0')), '')), 'UTF-32')"
    left, right = "coalesce(nullif({p}, 0) + {first}, {none})", "{p} + {first}"
    letters = [spell.format(t=t, few=side.format(p="array_position(w, x)", first=first, none=align.FIRST), many=side.format(p=place, first=first, none=align.FIRST)) for t, side in (("h", left), ("r", right))]
    bounds = f"transform(sequence(0, CAST(ceil(log2(greatest(n, {align.NEAR}) / {align.NEAR}) / 2) AS INT)), i -> CAST(pow(4, i) AS INT) * {align.NEAR})"
    bounded = f"CASE WHEN n <= {align.SHORT} THEN levenshtein(two.a, two.b) ELSE aggregate({bounds}, -1, (d, most) -> CASE WHEN d >= 0 THEN d ELSE levenshtein(two.a, two.b, most) END) END"
    distance = f"transform(array(struct({letters[0]} AS a, {letters[1]} AS b)), two -> transform(array(greatest(char_length(two.a), char_length(two.b))), n -> {bounded})[0])[0]"
    steps = "transform(sequence(CAST(floor(log2(size(w) + 1)) AS INT), 0, -1), i -> CAST(pow(2, i) AS INT))"
    many = "CAST(raise_error('too many different shared tokens in a row') AS INT)"
    edits = f"transform(array(array_sort(array_intersect(h, r))), w -> CASE WHEN size(w) <= {align.LETTERS - 2} THEN transform(array({steps}), steps -> {distance})[0] ELSE {many} END)[0]"
    bodies = {
        "norm_text(s STRING) RETURNS STRING": r"regexp_replace(regexp_replace(regexp_replace(lower(coalesce(s, '')), '(?U)[^\\p{L}\\p{N}_\\s]', ''), '(?U)\\s+', ' '), '^ | $', '')",
        "norm_tokens(s STRING) RETURNS ARRAY<STRING>": "filter(split(norm_text(s), ' '), x -> x <> '')",
        "content_tokens(t ARRAY<STRING>) RETURNS ARRAY<STRING>": f"filter(t, x -> NOT array_contains({_list(lexicon.FUNCTION_WORDS)}, x))",
        "token_recall(h ARRAY<STRING>, r ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(r) = 0 THEN 0D ELSE size(array_intersect(h, r)) / size(array_distinct(r)) END",
        "jaccard(h ARRAY<STRING>, r ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(r) = 0 THEN 0D ELSE size(array_intersect(h, r)) / greatest(size(array_union(h, r)), 1) END",
        "token_edit_distance(h ARRAY<STRING>, r ARRAY<STRING>) RETURNS INT": edits,
        "wer(h ARRAY<STRING>, r ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(r) > 0 THEN token_edit_distance(h, r) / size(r) END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("lcs_length", align.lcs_udf())
    return [*(h.split("(")[0] for h in bodies), "lcs_length"]


def scored_view(spark: SparkSession, source: str, name: str, use_ensemble: bool = False) -> None:
    """A temporary view `name`: the table or view `source` (hypothesis, reference) with the rubric's columns."""
    from parlance.operators import ensemble

    ensemble.score_pairs(spark.table(source), use_ensemble).createOrReplaceTempView(name)


