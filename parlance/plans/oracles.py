"""DuckDB SQL of the registered queries, on the same tables and with the same column names."""

from __future__ import annotations

from parlance.functions import lexicon
from parlance.plans import spoken
from parlance.plans.derive import PAIRS_SQL, RATINGS_SQL


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_FW, _STOP = _list(lexicon.FUNCTION_WORDS), _list(lexicon.ENSEMBLE_STOP_WORDS)
_FORMS = " ".join(lexicon.VERB_FORMS).split()
_GROUPS = "MAP {" + ", ".join(f"'{w}': {g}" for g, forms in enumerate(lexicon.VERB_FORMS) for w in forms.split()) + "}"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"


def _content(c: str, stop: str = _FW) -> str:
    return f"list_filter({c}, lambda x: NOT list_contains({stop}, x))"


def _shared(a: str, b: str) -> str:
    return f"len(list_distinct(list_filter({a}, lambda x: list_contains({b}, x))))"


def _ratio(a: str, n: str, none: float) -> str:
    return f"CASE WHEN {n} = 0 THEN {none}::DOUBLE ELSE ({a})::DOUBLE / {n} END"


_TOK = f"""{PAIRS_SQL},
tok0 AS (SELECT *, {_words(_norm('hypothesis'))} AS h, {_words(_norm('reference'))} AS r, {_words('lower(hypothesis)')} AS lh, {_words('lower(reference)')} AS lr FROM pairs),
tok AS (SELECT *, {_content('h')} AS hc, {_content('r')} AS rc, {_content('lh', _STOP)} AS lhc, {_content('lr', _STOP)} AS lrc FROM tok0),
over AS (SELECT *, {_ratio(_shared('h', 'r'), 'len(list_distinct(r))', 0)} AS token_overlap, {_ratio(_shared('hc', 'rc'), 'len(rc)', 1)} AS content_overlap,
  CASE WHEN len(lr) = 0 THEN 0::DOUBLE ELSE {_shared('lh', 'lr')}::DOUBLE / greatest(len(list_distinct(list_concat(lh, lr))), 1) END AS jaccard,
  {_ratio(_shared('lhc', 'lrc'), 'len(lrc)', 1)} AS semantic FROM tok)"""

# errors of each kind, named; first appearances of lexical ones in order
_ERR = f"""{_TOK},
err0 AS (SELECT *,
  CASE WHEN len(h) < 0.5 * len(r) THEN ['{lexicon.MAJOR_DELETION}'] WHEN len(h) > 1.5 * len(r) THEN ['{lexicon.MAJOR_INSERTION}'] ELSE [] END AS e1,
  list_filter([CASE WHEN h[i] <> r[i] AND ({_GROUPS})[h[i]] = ({_GROUPS})[r[i]] THEN 'Conjugation: ''' || h[i] || ''' vs ''' || r[i] || '''' END FOR i IN range(1, least(len(h), len(r)) + 1)], lambda x: x IS NOT NULL) AS e2,
  ['Missing content word: ''' || rc[i] || '''' FOR i IN range(1, len(rc) + 1) IF list_position(rc, rc[i]) = i AND NOT list_contains(hc, rc[i]) AND NOT coalesce(list_contains([({_GROUPS})[w] FOR w IN hc], ({_GROUPS})[rc[i]]), false)] AS e3,
  ['Omission: ''' || w || '''' FOR w IN rc IF NOT list_contains(h, w)] AS e4,
  ['Addition: ''' || w || '''' FOR w IN hc IF NOT list_contains(r, w)] AS e5
  FROM over),
err AS (SELECT *, list_concat(e1, e2) AS e12 FROM err0),
pen AS (SELECT *, len(h) = 0 AS silent, CASE WHEN len(h) > 0 THEN 2 * len(e12) + len(e3) + len(e4) + len(e5) END AS penalty FROM err),
scored AS (SELECT *,
  CASE WHEN silent THEN 0 WHEN content_overlap < 0.15 THEN 0 WHEN content_overlap < 0.35 THEN 1
       WHEN token_overlap >= 0.95 AND penalty <= 0 THEN 6 WHEN token_overlap >= 0.80 AND penalty <= 1 THEN 5
       WHEN token_overlap >= 0.70 AND penalty <= 2 THEN 4 WHEN token_overlap >= 0.60 AND penalty <= 4 THEN 3
       WHEN token_overlap >= 0.40 THEN 2 ELSE 1 END AS score,
  CASE WHEN silent OR token_overlap IN (0, 1) THEN 1::DOUBLE
       ELSE least(1, 0.5::DOUBLE + 2 * list_min([abs(token_overlap - t::DOUBLE) FOR t IN [0.40, 0.60, 0.70, 0.80, 0.95]])) END AS confidence,
  CASE WHEN silent THEN [] ELSE list_concat(e12, e3, e4, e5) END AS errors FROM pen)"""


def _kind(name: str, e: str) -> str:
    return f"CASE WHEN len({e}) > 0 THEN ' {name} (' || len({e}) || '): ' || array_to_string({e}[1:3], ', ') || '.' ELSE '' END"


def _category(c: str) -> str:
    return f"({_list(lexicon.CATEGORIES)})[{c} + 1]"



def _kappas(a: str, b: str, m: int, group: str = "") -> str:
    po = f"(1 - avg(({a} - {b}) * ({a} - {b})::DOUBLE) / {m * m})"
    pe = f"(1 - (avg(({a} * {a})::DOUBLE) + avg(({b} * {b})::DOUBLE) - 2 * avg({a}) * avg({b})) / {m * m})"
    return f"round(CASE WHEN {pe} = 0 THEN 1 ELSE {po} / nullif({pe}, 0) END, 6) AS kappa_ratio, round(CASE WHEN {pe} = 1 THEN 1 ELSE ({po} - {pe}) / nullif(1 - {pe}, 0) END, 6) AS kappa"


_PROTOCOL = f"""{RATINGS_SQL},
placed AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 20 AS p FROM ratings),
protocol AS (SELECT abs(sum(auto) - sum(human)) AS d FROM placed GROUP BY p HAVING count(*) = 20)"""

#: Least edits or longest subsequence of token lists, by a recursive table over the hypothesis.
_DP = """RECURSIVE {tables},
src AS (SELECT pair_id, conv_id, turn, role, {h} AS h, {r} AS r FROM tok),
dp(pair_id, i, prev) AS (
  SELECT pair_id, 0, range(0, len(r) + 1) FROM src
  UNION ALL
  SELECT d.pair_id, d.i + 1, list_reduce(list_concat([[(d.i + 1)::BIGINT]], [[least(d.prev[j + 1] + 1, d.prev[j] + CASE WHEN s.h[d.i + 1] = s.r[j] THEN 0 ELSE 1 END)] FOR j IN range(1, len(s.r) + 1)]), lambda row, x: list_append(row, least(x[1], row[-1] + 1)))
  FROM dp d JOIN src s USING (pair_id) WHERE d.i < len(s.h)),
dist AS (SELECT pair_id, prev[-1] AS distance FROM (SELECT pair_id, prev, i, max(i) OVER (PARTITION BY pair_id) AS last FROM dp) WHERE i = last)"""

_LCS = (
    _DP.replace("range(0, len(r) + 1)", "[0::BIGINT FOR x IN range(0, len(r) + 1)]")
    .replace("(d.i + 1)::BIGINT", "0::BIGINT")
    .replace("least(d.prev[j + 1] + 1, d.prev[j] + CASE WHEN s.h[d.i + 1] = s.r[j] THEN 0 ELSE 1 END)", "CASE WHEN s.h[d.i + 1] = s.r[j] THEN d.prev[j] + 1 ELSE d.prev[j + 1] END")
    .replace("least(x[1], row[-1] + 1)", "greatest(x[1], row[-1])")
)
_PAIR_WER = f"""WITH {_DP.format(tables=_TOK, h='lh', r='lr')},
m AS (SELECT s.*, CASE WHEN len(s.r) > 0 THEN d.distance::DOUBLE / len(s.r) END AS wer, trim(lower(p.hypothesis)) = trim(lower(p.reference)) AS exact_match FROM dist d JOIN src s USING (pair_id) JOIN pairs p USING (pair_id))"""

ORACLES: dict[str, str] = {
    "q_normalize_tokens": f"WITH {_TOK} SELECT conv_id, turn, array_to_string(r, ' ') AS normalized, len(r)::BIGINT AS n_tokens FROM tok",
    "q_content_words": f"WITH {_TOK} SELECT conv_id, turn, array_to_string(rc, ' ') AS content, array_to_string(lrc, ' ') AS ensemble_content FROM tok",
    "q_overlaps": f"WITH {_TOK} SELECT conv_id, turn, round(token_overlap, 6) AS token_overlap, round(content_overlap, 6) AS content_overlap, round(jaccard, 6) AS jaccard, round(semantic, 6) AS semantic FROM over",
    "q_error_counts": f"""WITH {_ERR}, m AS (SELECT *, {_shared('h', 'r')} AS mt FROM err)
      SELECT conv_id, turn, len(e1)::BIGINT AS n_length, len(e3)::BIGINT AS n_lexical, len(e4)::BIGINT AS n_omissions, len(e5)::BIGINT AS n_additions,
      len(r)::BIGINT AS ref_tokens, len(h)::BIGINT AS hyp_tokens, mt::BIGINT AS matched, greatest(len(r) - mt, 0)::BIGINT AS deletions, greatest(len(h) - mt, 0)::BIGINT AS insertions FROM m""",
    "q_errors": f"WITH {_ERR} SELECT conv_id, turn, array_to_string(list_sort(errors), '; ') AS errors FROM scored",
    "q_error_frequency": f"WITH {_ERR}, e AS (SELECT unnest(errors) AS e FROM scored) SELECT split_part(e, ':', 1) AS error_type, count(*) AS n FROM e GROUP BY 1",
    "q_error_share": f"WITH {_ERR} SELECT count(*) AS n, count(*) FILTER (len(errors) > 0) AS n_with_errors, round(avg((len(errors) > 0)::INT), 6) AS with_errors, round(avg((len(errors) = 0)::INT), 6) AS without_errors FROM scored",
    "q_rubric_score": f"WITH {_ERR} SELECT conv_id, turn, score, {_category('score')} AS category, coalesce(penalty, 0)::BIGINT AS penalty, round(confidence, 6) AS confidence, round(score / 6.0::DOUBLE, 6) AS normalized_score, score = 6 AS is_perfect, score = 0 AS is_zero FROM scored",
    "q_rubric_reasoning": f"""WITH {_ERR} SELECT conv_id, turn, score, CASE WHEN silent THEN '{lexicon.EMPTY_REASON}' ELSE
      'Score: ' || score || '/6. Token overlap: ' || printf('%.1f', round_even(token_overlap * 100, 1)) || '%, content overlap: ' || printf('%.1f', round_even(content_overlap * 100, 1)) || '%.'
      || {_kind('Structural errors', 'e12')} || {_kind('Lexical errors', 'e3')} || {_kind('Omissions', 'e4')} || {_kind('Additions', 'e5')}
      || CASE WHEN len(errors) = 0 THEN ' No significant errors detected.' ELSE '' END END AS reasoning FROM scored""",
    "q_conjugation": f"""WITH {_TOK}, f AS (SELECT conv_id, turn, pair_id, len(r) AS n FROM tok),
      w AS (SELECT conv_id, turn, [({_list(_FORMS)})[(pair_id + i) % {len(_FORMS)} + 1] FOR i IN range(n)] AS h, [({_list(_FORMS)})[(pair_id * 3 + i * 2) % {len(_FORMS)} + 1] FOR i IN range(n)] AS r FROM f)
      SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN h[i] <> r[i] AND ({_GROUPS})[h[i]] = ({_GROUPS})[r[i]] THEN 'Conjugation: ''' || h[i] || ''' vs ''' || r[i] || '''' END FOR i IN range(1, len(h) + 1)], lambda x: x IS NOT NULL), '; ') AS errors FROM w""",
    "q_token_edit_distance": f"WITH {_DP.format(tables=_TOK, h='h', r='r')} SELECT s.conv_id, s.turn, d.distance FROM dist d JOIN src s USING (pair_id)",
    "q_wer_micro": f"""WITH {_DP.format(tables=_TOK, h='lh', r='lr')} SELECT s.role, sum(d.distance)::BIGINT AS n_errors, sum(len(s.r))::BIGINT AS n_words, round(sum(d.distance) / greatest(sum(len(s.r)), 1), 6) AS wer FROM dist d JOIN src s USING (pair_id) GROUP BY 1""",
    "q_lcs_length": f"WITH {_LCS.format(tables=_TOK, h='h', r='r')} SELECT s.conv_id, s.turn, d.distance AS lcs FROM dist d JOIN src s USING (pair_id)",
    "q_ensemble_score": f"""WITH {_LCS.format(tables=_ERR, h='lh', r='lr')},
      mixed AS (SELECT o.*, o.confidence AS rule_confidence, o.score AS rule_score, 0.4::DOUBLE * o.confidence AS w,
        jaccard * 6 * 0.2::DOUBLE + d.distance::DOUBLE / greatest(len(lh), len(lr), 1) * 6 * 0.2::DOUBLE + semantic * 6 * 0.2::DOUBLE AS v FROM scored o JOIN dist d USING (pair_id)),
      done AS (SELECT *, CASE WHEN rule_confidence >= 0.85 THEN rule_score ELSE round_even((v + rule_score * w) / (0.2::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE + w), 0)::INT END AS final FROM mixed)
      SELECT conv_id, turn, rule_score, round(rule_confidence, 6) AS rule_confidence, final AS score, round(CASE WHEN rule_confidence >= 0.85 THEN rule_confidence ELSE 0.5 * rule_confidence + 0.5 END, 6) AS confidence,
      {_category('rule_score')} AS category, {_category('final')} AS final_category FROM done""",
    "q_pair_wer": f"{_PAIR_WER} SELECT conv_id, turn, round(wer, 6) AS wer, exact_match FROM m",
    "q_wer_macro": f"{_PAIR_WER} SELECT role, count(*) AS n_samples, round(avg(wer), 6) AS avg_wer, round(avg(exact_match::INT), 6) AS exact_match_rate, avg(wer) <= 0.10 AS meets_target FROM m GROUP BY role",
    "q_compare_transcripts": f"{_PAIR_WER} SELECT count(*) AS n_samples, round(avg(wer), 6) AS avg_wer, round(avg(exact_match::INT), 6) AS exact_match_rate FROM m",
    "q_percent_agreement": f"WITH {PAIRS_SQL} SELECT role, round(avg((hypothesis = reference)::INT), 6) AS agreement FROM pairs GROUP BY 1",
    "q_item_agreement": f"""WITH {RATINGS_SQL}, d AS (SELECT *, abs(auto - human) AS d FROM ratings) SELECT count(*) AS n, round(avg(d), 6) AS mean_diff, round(stddev_pop(d), 6) AS std_diff, max(d)::BIGINT AS max_diff, min(d)::BIGINT AS min_diff,
      round(avg((d = 0)::INT), 6) AS exact, round(avg((d <= 1)::INT), 6) AS within_1, round(avg((d <= 2)::INT), 6) AS within_2, kappa_ratio, count(*) FILTER (d > 2) AS problem_cases, round(avg((d > 2)::INT), 6) AS problem_rate
      FROM d, (SELECT {_kappas('auto', 'human', 6)} FROM ratings) GROUP BY kappa_ratio""",
    "q_kappa": f"WITH {RATINGS_SQL} SELECT user_id, {_kappas('auto', 'human', 6)} FROM ratings GROUP BY user_id",
    "q_label_kappa": f"SELECT {_kappas('quality', 'toxic', 1)} FROM labels",
    "q_protocol_agreement": f"WITH {_PROTOCOL} SELECT count(*) AS n_protocols, 120::BIGINT AS max_total, round(avg(d), 6) AS mean_diff, round(stddev_pop(d), 6) AS std_diff, max(d)::BIGINT AS max_diff, round(avg((d <= 10)::INT), 6) AS within_10_pts, round(avg((d <= 6)::INT), 6) AS within_5_percent FROM protocol",
    "q_score_difference_stats": f"WITH {_PROTOCOL} SELECT count(*) AS n_protocols, round(avg(d), 6) AS mean_diff, round(sqrt(avg(d * d)), 6) AS rmse, max(d)::DOUBLE AS max_diff, round(avg((d <= 10)::INT), 6) AS within_10 FROM protocol",
    "q_confusion_matrix": f"WITH {RATINGS_SQL} SELECT a.x::INT AS actual, p.x::INT AS predicted, count(auto) AS n FROM range(7) a(x) CROSS JOIN range(7) p(x) LEFT JOIN ratings ON auto = a.x AND human = p.x GROUP BY 1, 2",
    "q_confusion_matrix_found_labels": "WITH v AS (SELECT quality AS x FROM labels UNION SELECT toxic FROM labels) SELECT a.x AS actual, p.x AS predicted, count(doc_id) AS n FROM v a CROSS JOIN v p LEFT JOIN labels ON quality = a.x AND toxic = p.x GROUP BY 1, 2",
    "q_score_histogram": f"WITH {_ERR} SELECT g.x::INT AS score, count(scored.pair_id) AS n, round(100.0::DOUBLE * count(scored.pair_id) / (SELECT count(*) FROM scored), 6) AS percent FROM range(7) g(x) LEFT JOIN scored ON score = g.x GROUP BY 1",
    "q_score_value_counts": f"WITH {_ERR} SELECT score, count(*) AS n FROM scored GROUP BY 1",
    "q_score_statistics": f"WITH {_ERR} SELECT role, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_samp(score), 6) AS std, min(score) AS min, max(score) AS max FROM scored GROUP BY 1",
    "q_confidence_split": f"WITH {_ERR} SELECT count(*) FILTER (confidence >= 0.85) AS n_high, count(*) FILTER (confidence < 0.85) AS n_low, round(avg((confidence >= 0.85)::INT), 6) AS high, round(avg((confidence < 0.85)::INT), 6) AS low FROM scored",
    "q_report_summary": f"WITH {_PROTOCOL} SELECT round(e, 6) AS exact, e >= 0.90 AS meets_goal, round(w, 6) AS protocol_accuracy FROM (SELECT avg((auto = human)::INT) AS e FROM ratings), (SELECT avg((d <= 10)::INT) AS w FROM protocol)",
    "q_top_disagreements": f"WITH {RATINGS_SQL} SELECT event_id, auto, human, abs(auto - human) AS diff FROM ratings WHERE auto <> human ORDER BY diff DESC, event_id LIMIT 10",
    "q_outliers": f"WITH {RATINGS_SQL} SELECT event_id, abs(auto - human) AS diff FROM ratings WHERE abs(auto - human) > 2",
    "q_explain_diff": f"""WITH {_TOK}, a AS (SELECT conv_id, turn, lh AS a, lr AS b FROM tok)
      SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ' ') AS removed, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))), ' ') AS added,
      array_to_string(list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x)))), ' ') AS unchanged FROM a""",
    "q_merge_segments": f"WITH {_ERR} SELECT conv_id, trim(string_agg(hypothesis, ' ' ORDER BY turn)) AS transcription, round(avg(confidence), 6) AS confidence FROM scored GROUP BY 1",
    "q_sample_ids": "SELECT event_id, printf('sample_%03d', row_number() OVER (ORDER BY event_id) - 1) AS sample_id FROM events",
    "q_event_segments": """WITH f AS (SELECT user_id, coalesce(value > 50, false) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
      g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) <= 3 THEN 0 ELSE 1 END AS o FROM f WHERE s),
      h AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY i) AS k FROM g),
      e AS (SELECT user_id, min(i) AS start_frame, max(i) AS z, max(n) AS n FROM h GROUP BY user_id, k)
      SELECT user_id, start_frame, CASE WHEN n - 1 - z < 3 THEN n ELSE z END AS end_frame, n - 1 - z < 3 AS tail FROM e""",
    "q_score_by_role": f"WITH {_ERR} SELECT role, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (score = 6) AS n_perfect FROM scored GROUP BY 1",
    "q_rms_normalize": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
      g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)) AS l FROM v),
      n AS (SELECT vec_id, list_transform(e, lambda x: greatest(-1, least(1, x * CASE WHEN l > 1e-8 THEN 0.1 / l ELSE 1 END))) AS e FROM g)
      SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)), 5) AS rms, round(list_max(e), 5) AS peak FROM n""",
    "q_mean_log_prob": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 6) AS confidence FROM embeddings",
    "q_mono": "SELECT vec_id, len(embedding)::BIGINT AS samples, round(list_max([(embedding[i] + embedding[len(embedding) + 1 - i])::DOUBLE / 2 FOR i IN range(1, len(embedding) + 1)]), 5) AS peak FROM embeddings",
    "q_manifest": f"SELECT url AS audio, '{lexicon.MANIFEST_TEXT}' AS reference FROM pages",
}
ORACLES["q_usable_segments"] = f"SELECT user_id, start_frame AS start_time, end_frame - start_frame AS duration FROM ({ORACLES['q_event_segments']}) WHERE end_frame - start_frame BETWEEN 2 AND 30"

# character distances: DuckDB's levenshtein compares bytes, so that every other letter becomes a byte that lower-case text doesn't have
ORACLES["q_pair_cer"] = rf"""WITH {PAIRS_SQL},
  p AS (SELECT conv_id, turn, regexp_replace(lower(hypothesis), '^\s+|\s+$', '', 'g') AS h, regexp_replace(lower(reference), '^\s+|\s+$', '', 'g') AS r FROM pairs),
  c AS (SELECT string_agg(c, '' ORDER BY c) AS wide FROM (SELECT DISTINCT unnest(string_split(h || r, '')) AS c FROM p) WHERE unicode(c) > 127),
  m AS (SELECT wide, CASE WHEN length(wide) > 51 THEN error('more letters than bytes') ELSE 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || array_to_string([chr(i::INT) FOR i IN range(1, 32) IF i NOT BETWEEN 9 AND 13], '') END AS narrow FROM c)
  SELECT conv_id, turn, CASE WHEN length(r) > 0 THEN round(levenshtein(translate(h, wide, narrow[:length(wide)]), translate(r, wide, narrow[:length(wide)])) / length(r)::DOUBLE, 6) END AS cer FROM p, m"""

# words between marks, as this dialect's word boundary knows ASCII only; the rules that change nothing in lower case are left out
_WORDS = "lower('Um, ' || reference || ' — este [ruido] fui... aber (risas) esta casa graned.')"
_WORDS = f"replace(regexp_replace(regexp_replace({_WORDS}, '[.!?]+$', ''), '[—–-]+', ' ', 'g'), ',', '')"
_WORDS = rf"regexp_replace({_WORDS}, '([\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+)', '‹\1›', 'g')"
_SAID = r"‹(?:um+|uh+|eh+|ah+|mm+)›|‹(?:este|bueno|o› ‹sea|pues|a› ‹ver)›|‹(?:como› ‹se› ‹dice|espera|no› ‹sé)›|\.{2,}|\[[^\n]*?\]|\([^\n]*?\)"
_WORDS = f"regexp_replace({_WORDS}, '{_SAID}', ' ', 'g')"
for _a, _b in (("salio", "salió"), ("comio", "comió"), ("aber", "haber"), ("alla", "allá")):
    _WORDS = f"replace({_WORDS}, '‹{_a}›', '‹{_b}›')"
for _ in range(2):  # a match takes the next word's first letter, so that every second one of a row is found
    _WORDS = rf"regexp_replace({_WORDS}, '‹esta› ‹([a-z])', '‹está› ‹\1', 'g')"
for _a, _b in (("graned", "grande"), ("ciud\u0430\u0442", "ciudad")):
    _WORDS = f"replace({_WORDS}, '‹{_a}›', '‹{_b}›')"
ORACLES["q_postprocess"] = rf"WITH {PAIRS_SQL} SELECT conv_id, turn, trim(regexp_replace(translate({_WORDS}, '‹›', ''), '\s+', ' ', 'g')) AS text FROM pairs"

ORACLES["q_waveform_segments"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
  f AS (SELECT vec_id, i, len(e) // 4 AS n, sqrt((e[4 * i + 1] ** 2 + e[4 * i + 2] ** 2 + e[4 * i + 3] ** 2 + e[4 * i + 4] ** 2) / 4) > 0.13 AS s FROM (SELECT vec_id, e, unnest(range(len(e) // 4)) AS i FROM v)),
  g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY vec_id ORDER BY i) <= 2 THEN 0 ELSE 1 END AS o FROM f WHERE s),
  h AS (SELECT *, sum(o) OVER (PARTITION BY vec_id ORDER BY i) AS k, lag(i) OVER (PARTITION BY vec_id ORDER BY i) AS y FROM g),
  r AS (SELECT vec_id, k - 1 AS segment, min(i) AS a, max(i) AS z, max(y) AS y, max(n) AS n FROM h GROUP BY vec_id, k),
  t AS (SELECT vec_id, segment, 4 * a AS b, CASE WHEN n - 1 - z < 2 THEN 4 * (z + 1) WHEN z = a THEN 4 * a ELSE 4 * (y + 1) END AS c FROM r)
  SELECT vec_id, segment::BIGINT AS segment, b::DOUBLE AS start, c::DOUBLE AS "end", c - b AS samples FROM t
  UNION ALL SELECT vec_id, 0, 0, len(e), len(e) FROM v WHERE vec_id NOT IN (SELECT vec_id FROM t)"""

# sources, sinks and commands: the tables that the files were written from
ORACLES |= {
    "q_csv_texts": "SELECT doc_id, length(text) AS n_chars, md5(text) AS md5 FROM documents",
    "q_score_command": f"SELECT conv_id, turn, score AS auto_score, reasoning, confidence, category FROM ({ORACLES['q_rubric_reasoning']}) JOIN (SELECT * EXCLUDE (score), score AS same FROM ({ORACLES['q_rubric_score']})) USING (conv_id, turn)",
    "q_score_batch_command": f"WITH {_ERR} SELECT score, {_category('score')} AS category, count(*) AS n, sum(len(errors))::BIGINT AS n_errors, round(avg(confidence), 6) AS confidence, sum(length(reference))::BIGINT AS n_chars FROM scored GROUP BY score",
    "q_evaluate_command": f"""SELECT round(w.wer, 6) AS wer, round(a.agreement, 6) AS agreement, a.samples, 0.1::DOUBLE AS goal_wer, w.wer <= 0.1 AS meets_target
      FROM (WITH {_DP.format(tables=_TOK, h='lh', r='lr')} SELECT sum(d.distance) / greatest(sum(len(s.r)), 1) AS wer FROM dist d JOIN src s USING (pair_id)) w, (WITH {PAIRS_SQL} SELECT avg((hypothesis = reference)::INT) AS agreement, count(*) AS samples FROM pairs) a""",
    "q_validate_command": f"WITH {RATINGS_SQL} SELECT count(*) AS n, round(avg(abs(auto - human)), 6) AS mean_diff, round(avg((auto = human)::INT), 6) AS exact, count(*) // 20 AS n_protocols, avg((auto = human)::INT) >= 0.90 AS meets_goal FROM ratings",
    "q_compare_raters_command": f"SELECT 'ana vs luis' AS comparison, n, max_diff, mean_diff, exact, within_1, kappa_ratio FROM ({ORACLES['q_item_agreement']})",
    "q_manifest_join": f"SELECT printf('%06d.wav', page_id) AS file, printf('said in %06d.wav', page_id) AS transcription, '{lexicon.MANIFEST_TEXT}' AS reference FROM pages",
    "q_transcription_csv": f"""WITH {PAIRS_SQL}, s AS (SELECT *, trim(hypothesis) <> '' AS spoken FROM pairs)
      SELECT conv_id AS file, coalesce(string_agg(hypothesis, ' ' ORDER BY turn) FILTER (spoken), '') AS transcription, coalesce(round(avg(pair_id % 5 / 8::DOUBLE) FILTER (spoken), 6), 0) AS confidence FROM s GROUP BY 1""",
    "q_evaluation_files": f"{_PAIR_WER} SELECT pair_id AS sample, round(wer, 6) AS wer, exact_match, (SELECT count(*) FROM m) AS n_samples, (SELECT round(avg(wer), 6) FROM m) AS avg_wer FROM m",
    "q_report_row": f"""WITH {_DP.format(tables=_TOK, h='lh', r='lr')},
      z AS (SELECT pair_id, pair_id % 7 AS auto, least(6, pair_id % 7 + (pair_id % 3 = 0)::INT) AS human FROM pairs),
      placed AS (SELECT *, (row_number() OVER (ORDER BY pair_id) - 1) // 20 AS p FROM z),
      protocol AS (SELECT abs(sum(auto) - sum(human)) AS d FROM placed GROUP BY p HAVING count(*) = 20),
      k AS (SELECT avg((auto = human)::INT) AS agreement, {_kappas('auto', 'human', 6)} FROM z),
      e AS (SELECT sum(d.distance) / greatest(sum(len(s.r)), 1) AS wer FROM dist d JOIN src s USING (pair_id))
      SELECT round(e.wer, 6) AS wer, round(k.agreement, 6) AS agreement, k.kappa_ratio, round(avg(d), 6) AS mean_diff, round(sqrt(avg(d * d)), 6) AS rmse, max(d)::DOUBLE AS max_diff, round(avg((d <= 10)::INT), 6) AS within_10 FROM protocol, k, e GROUP BY ALL""",
    "q_in_memory": f"""WITH {PAIRS_SQL}, x AS (SELECT role, arg_min(hypothesis, pair_id) AS h, arg_min(reference, pair_id) AS r FROM pairs GROUP BY role),
      v AS (SELECT h AS hypothesis, r AS reference FROM x UNION ALL SELECT r, '' FROM x UNION ALL SELECT role, h FROM x)
      SELECT *, len({_words('reference')})::BIGINT AS n_words FROM v""",
    "q_word_count": f"SELECT doc_id, len({_words("coalesce(text, '')")})::BIGINT AS n_words FROM documents",
    # the convolution itself: each sample weighed by a windowed sinc of its distance to the output, in a band of 0.99 of the lower rate's
    "q_resampled": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, len(embedding) AS m, (len(embedding) * 3 + 1) // 2 AS n FROM embeddings),
      s AS (SELECT DISTINCT m, n FROM v),
      d AS (SELECT m, n, t, j, (j / 2.0::DOUBLE - t / 3.0::DOUBLE) * 1.98 AS x FROM s, unnest(range(n)) a(t), unnest(range(m)) b(j)),
      k AS (SELECT m, n, t, list(CASE WHEN abs(x) >= 6 THEN 0 WHEN x = 0 THEN 0.99 ELSE 0.99 * sin(pi() * x) / (pi() * x) * cos(pi() * x / 12) ** 2 END ORDER BY j) AS c FROM d GROUP BY m, n, t),
      y AS (SELECT vec_id, v.n, list_dot_product(e, c) AS y FROM v JOIN k USING (m, n))
      SELECT vec_id, any_value(n) AS samples, round(sqrt(avg(y * y)), 4) AS rms, 24000::BIGINT AS sample_rate FROM y GROUP BY vec_id""",
    "q_truncated": "SELECT vec_id, least(len(embedding), 20) AS samples, round(sqrt(list_sum(list_transform(embedding[:20], lambda x: x::DOUBLE * x::DOUBLE)) / least(len(embedding), 20)), 5) AS rms FROM embeddings",
}
ORACLES |= {
    "q_transcribe_files": spoken.ORACLE,
    "q_recording_segments": spoken.SEGMENTS,
    "q_compare_files": f"""{_PAIR_WER} SELECT row_number() OVER (ORDER BY pair_id) - 1 AS position, printf('sample_%03d', row_number() OVER (ORDER BY pair_id) - 1) AS audio_file, round(wer, 6) AS wer, exact_match, {_shared('h', 'r')}::BIGINT AS matched FROM m""",
    "q_score_own_columns": f"SELECT conv_id, turn, c.category, 'human ' || ((conv_id * 64 + turn) % 7) AS score, conv_id * 64 + turn AS errors, auto_score, confidence FROM ({ORACLES['q_score_command']}) c",
    "q_evaluation_document": f"{_PAIR_WER} SELECT pair_id AS sample, round(wer, 6) AS wer, exact_match FROM m",
}
ORACLES |= {
    "q_frequent_labels": "WITH v AS (SELECT user_id AS label FROM events UNION ALL SELECT user_id % 40 FROM events) SELECT label, count(*) AS n FROM v WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 0.01 * (SELECT count(label) FROM v)",
    "q_value_quantiles": "SELECT event_type, probability, count(value) AS n, true AS within FROM events, (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (0.9)) p(probability) GROUP BY ALL",
}
