"""Quality rules as a short-circuit cascade.

Each rule is a cheap test of a text. Its cost (seconds a document) and its
selectivity (share of documents that it rejects) are measured on a sample, and
the rules then run in descending order of rejection per cost: a document that a
rule rejects is seen by no later rule. A verdict is "no rule rejects", which no
order changes; the sample decides speed only.

Edge cases: a null or empty text has no words, so the base rule rejects it; a
text of any length is judged whole; a repeated row gets the verdict of its copy, and
a row without id its text's; an empty table gives an empty table; other columns,
whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import common
from parlance.llm.common import prepare

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


@dataclass(frozen=True)
class Base:
    """The counts that the contract returns for every document; rules may read them at no cost."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[str, Base], bool]


_LETTER = re.compile(r"[^\W\d_]")
_CAPS = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def _mostly_symbols(_: str, b: Base) -> bool:
    return 5 * b.n_symbols > b.n_words


def _long_or_short_words(_: str, b: Base) -> bool:
    return not 2 * b.n_words <= b.word_chars <= 24 * b.n_words


def _repeated_lines(text: str, b: Base) -> bool:
    return 10 * b.n_dup_lines > 3 * (1 + text.count("\n"))


def _shouting(text: str, _: Base) -> bool:
    return len(_CAPS.findall(text)) * 2 > len(_LETTER.findall(text))


def _exclaiming(text: str, b: Base) -> bool:
    return 2 * text.count("!") > b.n_words


def _few_letters(text: str, b: Base) -> bool:
    return 2 * len(_LETTER.findall(text)) < b.word_chars


def _stutter(text: str, b: Base) -> bool:
    """A word that at once follows itself, more than in three of ten places."""
    w = text.split()
    return 10 * sum(map(str.__eq__, w, w[1:])) > 3 * len(w)


RULES = (
    Rule("mostly_symbols", _mostly_symbols),
    Rule("long_or_short_words", _long_or_short_words),
    Rule("repeated_lines", _repeated_lines),
    Rule("shouting", _shouting),
    Rule("exclaiming", _exclaiming),
    Rule("few_letters", _few_letters),
    Rule("stutter", _stutter),
)


def base_counts(texts: pa.Array) -> np.ndarray:
    """A row (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) for each text."""
    out = np.zeros((len(texts), 5), np.int64)
    for i, buf, off in common.slices(texts):
        n = len(off) - 1
        rows = slice(i, i + n)
        h, first, start, end = common.words_of(buf, off)
        out[rows, 0] = np.diff(first)
        # code points in words: bytes that are no continuation and no white space
        lead = np.concatenate([[0], np.cumsum(((buf & 0xC0) != 0x80) & ~common._SPACE[buf])])
        out[rows, 1] = np.diff(lead[off])
        out[rows, 2] = np.diff(np.concatenate([[0], np.cumsum(SYMBOLS[buf])])[off])
        out[rows, 3] = _dup_lines(buf, off, start)
        w, at = common.windows(h, first, 5)
        if len(w):
            row = np.searchsorted(first, at, "right") - 1
            key = common.mix(w + common.mix(row.astype(np.uint64)))
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            twice = at[count[back] > 1]
            hit = np.zeros(len(h) + 1, np.int64)
            np.add.at(hit, twice, 1)
            np.add.at(hit, twice + 5, -1)
            covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
            out[rows, 4] = np.diff(covered[first])
    return out


def _dup_lines(buf: np.ndarray, off: np.ndarray, word_start: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    nl = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate([off[:-1], nl + 1]))
    start = start[start < len(buf)]
    if not len(start):
        return np.zeros(n, np.int64)
    row = np.searchsorted(off, start, "right") - 1
    end = np.minimum(np.append(nl, len(buf))[np.searchsorted(nl, start)], off[row + 1])
    full = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end, row = start[full], end[full], row[full]
    key = common.mix(common.span_hashes(buf, start, end) + common.mix(row.astype(np.uint64)))
    _, kept = np.unique(key, return_index=True)
    return np.bincount(row, minlength=n) - np.bincount(row[kept], minlength=n)


def base_failed(b: Base) -> bool:
    return b.n_words < 10 or 100 * b.n_repeat_words > 20 * b.n_words


def ordered(sample: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a document, share rejected), most rejection per cost first."""
    texts = [t or "" for t in sample]
    bases = [Base(*r) for r in base_counts(pa.array(texts, pa.string())).tolist()]
    found = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(rule.rejects(t, b) for t, b in zip(texts, bases, strict=True))
        cost = (time.perf_counter() - began) / max(1, len(texts))
        found.append((rule, cost, (rejected + 0.5) / (len(texts) + 1)))
    return sorted(found, key=lambda x: -x[2] / max(x[1], 1e-9))


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 256, sample_chars: int = 100_000) -> DataFrame:
    """Judge `doc_id, text`. The cascade's order is estimated on about sample_rows whole texts of at most sample_chars each, drawn from all rows; every text is judged."""
    prepare(df.sparkSession)
    df = df.select("doc_id", "text")
    # every row has the same chance, whatever its id; the limit only bounds what chance may add
    share = min(1.0, sample_rows / max(1, df.count()))
    drawn = df.select("text").sample(share, seed=17).where(F.coalesce(F.length("text"), F.lit(0)) <= sample_chars)
    sample = [r.text for r in drawn.limit(2 * sample_rows).collect()]
    cascade = tuple(r for r, _, _ in ordered(sample, rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = base_counts(batch["text"])
            failed, by = [], []
            for row, text in zip(counts.tolist(), batch["text"], strict=True):
                b = Base(*row)
                failed.append(base_failed(b))
                text = None if failed[-1] else text.as_py() or ""
                by.append("base" if failed[-1] else next((r.name for r in cascade if r.rejects(text, b)), None))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed, pa.bool_()), pa.array([x is None for x in by], pa.bool_()), pa.array(by, pa.string())],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return df.mapInArrow(judge, SCHEMA)


#: DuckDB SQL of the query.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]')) AS caps, len(regexp_extract_all(t, '[\p{L}\p{Nl}\p{No}]')) AS letters,
         length(t) - length(replace(t, chr(10), '')) AS breaks, length(t) - length(replace(t, '!', '')) AS calls
  FROM d),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM n),
k AS (
  SELECT doc_id, i, x = lead(x) OVER o AS same, CASE WHEN lead(x, 4) OVER o IS NOT NULL THEN concat_ws(' ', x, lead(x) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) END AS k
  FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM k WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) r(j) GROUP BY doc_id),
stutter AS (SELECT doc_id, count(*) FILTER (same) AS n FROM k GROUP BY doc_id),
b AS (
  SELECT n.*, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(stutter.n, 0) AS stutters
  FROM n LEFT JOIN covered USING (doc_id) LEFT JOIN stutter USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR NOT (2 * n_words <= word_chars AND word_chars <= 24 * n_words) OR 10 * n_dup_lines > 3 * (1 + breaks)
            OR 2 * caps > letters OR 2 * calls > n_words OR 2 * letters < word_chars OR 10 * stutters > 3 * n_words) AS kept
FROM f
"""
