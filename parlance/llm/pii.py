"""Personal data by anchor expansion.

An Aho-Corasick automaton walks the whole text once and stops at anchors: at
signs, digits, plus signs, URL schemes and identifier cues. At each anchor a
deterministic local parser expands to the left and right, finds the boundaries
of the address or account and validates it (part ranges, digit counts, Luhn and
mod-97 sums). Matches of one kind don't overlap and the leftmost wins; a match
that fails validation is dropped and its characters aren't tried again. No
character is read more than a few times: a run of digits is parsed from its first
digit only, and where no parser can begin inside what another try has read, the
walk goes on behind it.

Edge cases: a null or empty text has no spans; a repeated row gets the spans of
its copy; a text of any length, of one character even, is walked in linear time;
an empty table gives an empty table; other columns are neither read nor returned
by `scan`, and stay as they are in `redact`, which changes one column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import prepare

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds to the base, in the order of their spans.
ADDED = ("login_url", "iban", "secret")
KINDS = BASE + ADDED
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_RUN = re.compile("[0-9]+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/@:?#<>\"']++:[^\s/@?#<>\"']++@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}")
_SECRET = re.compile(r"""[\x20_-]?(?:key)?["']?[\x20]?[:=][\x20]?["']?([A-Za-z0-9_+/=-]{16,})""")
#: Characters between a cue and its value, at most.
SEPARATOR = 9
#: Words that announce a secret value.
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, anchors in (("@", "@"), ("0", "0123456789"), ("+", "+")):
        for x in anchors:
            a.add_word(x, (kind, 1))
    a.add_word("://", (":", 3))
    for cue in CUES:
        for x in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(x, ("s", len(x)))
    a.make_automaton()
    return a


_AC: list[ahocorasick.Automaton] = []


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def find(text: str | None) -> dict[str, list[Span]]:
    """Spans (code points, end exclusive) of each kind, by start."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not text:
        return out
    if not _AC:
        _AC.append(_automaton())
    email_to = run_to = ip_to = card_to = phone_to = login_to = secret_to = tried_to = iban_to = 0
    for last, (kind, size) in _AC[0].iter(text):
        at = last + 1 - size
        if kind == "0":
            # every parser of digits begins at the first one of a run: what it reads ends at the end of a run
            if at < run_to:
                continue
            run_to = _RUN.match(text, at).end()
            if at >= ip_to and (m := _IP.match(text, at)):
                ip_to = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                    out["ip"].append(m.span())
            if at >= card_to and (m := _CARD.match(text, at)):
                card_to = m.end()
                if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                    out["card"].append(m.span())
            if at >= max(iban_to, 2) and text[at - 2 : at].isupper() and (m := _IBAN.match(text, at - 2)) and (at == 2 or not text[at - 3].isalnum()):
                if end := _iban_end(text, m.start(), m.end()):
                    out["iban"].append((at - 2, end))
                    iban_to = end
        elif kind == "@":
            start = at
            while start > email_to and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                out["email"].append((start, m.end()))
                email_to = m.end()
        elif kind == "+":
            if at >= phone_to and (m := _PHONE.match(text, at)):
                phone_to = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    out["phone"].append(m.span())
        elif kind == ":":
            if at >= login_to and (m := _LOGIN.match(text, at)):
                start = at
                while start > login_to and at - start < 12 and text[start - 1].isalpha():
                    start -= 1
                out["login_url"].append((start, m.end()))
                login_to = m.end()
        elif last >= secret_to and last + SEPARATOR >= tried_to and (m := _SECRET.match(text, last + 1)):
            if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]):
                out["secret"].append(m.span(1))
                secret_to = m.end()
            # a value without a digit or a letter holds none that has both: only one behind it is tried
            tried_to = m.end()
    return out


def _iban_end(text: str, start: int, end: int) -> int | None:
    """The longest end at which the sum is right."""
    while end - start >= 15:
        if text[end - 1] != " " and not text[end : end + 1].isalnum() and 15 <= len(code := text[start:end].replace(" ", "")) <= 34 and mod97(code):
            return end
        end -= 1
    return None


def joined(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def scan(df: DataFrame) -> DataFrame:
    """The contract's row for each `doc_id, text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].cast(pa.int64()),
                    *(pa.array([len(r[k]) for r in rows], pa.int64()) for k in BASE),
                    pa.array([hashlib.sha256(joined(r, BASE).encode()).hexdigest() for r in rows], pa.string()),
                    pa.array([joined(r, KINDS) for r in rows], pa.string()),
                    pa.array([sum(len(r[k]) for k in ADDED) for r in rows], pa.int64()),
                    pa.array([sum(map(len, r.values())) for r in rows], pa.int64()),
                ],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    prepare(df.sparkSession)
    return df.select("doc_id", "text").mapInArrow(run, SCHEMA)


def mask(text: str | None) -> str | None:
    """The text with each span as its kind in brackets; of overlapping spans, the leftmost and then longest stays."""
    if not text:
        return text
    out, done = [], 0
    for start, less, kind in sorted((a, -b, k) for k, spans in find(text).items() for a, b in spans):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
            done = -less
    return "".join(out) + text[done:] if done else text


def redact(df: DataFrame, column: str = "text") -> DataFrame:
    """`column` masked, every other column as it is."""
    prepare(df.sparkSession)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(mask, na_action="ignore")

    return df.withColumn(column, masked(F.col(column)))


def _oracle() -> str:
    """DuckDB SQL of the query, for tables whose ids are unique: each kind's matches between marks, then the same checks.

    Of account numbers with no more than a space between them, it finds the first only, and no secret whose cue ends a value that failed.
    """
    at, to = "\ue000", "\ue001"
    space = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
    cues = "|".join(x for cue in CUES for x in (cue, cue.upper(), cue.capitalize()))
    # (what comes before, the match)
    patterns = {
        "email": ("()", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        "ip": ("()", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
        "card": ("()", r"[0-9](?:[\x20-]?[0-9])+"),
        "phone": ("()", r"\+[0-9][\x20().0-9-]+[0-9]"),
        "login_url": ("()", rf"\p{{L}}{{0,12}}://[^{space}/@:?#<>\"']+:[^{space}/@?#<>\"']+@[A-Za-z0-9.-]+"),
        "iban": (r"(^|[^\p{L}\p{N}])", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"),
        "secret": (rf"((?:{cues})[\x20_-]?(?:key)?[\"']?\x20?[:=]\x20?[\"']?)", "[A-Za-z0-9_+/=-]{16,}"),
    }
    marked = [f"SELECT doc_id, {n} AS o, '{kind}' AS kind, regexp_replace(t, '{(before + '(' + match + ')').replace(chr(39), chr(39) * 2)}', '\\1{at}\\2{to}', 'g') AS m FROM d" for n, (kind, (before, match)) in enumerate(patterns.items())]
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(marked)}),
p AS (SELECT doc_id, o, kind, unnest(string_split(m, '{at}')) AS part, generate_subscripts(string_split(m, '{at}'), 1) AS i FROM m WHERE contains(m, '{at}')),
w AS (SELECT doc_id, o, kind, i, split_part(part, '{to}', 1) AS x, substr(split_part(part, '{to}', 2), 1, 1) AS follows, length(part) - (i > 1)::INT AS n FROM p),
s AS (SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS digits, sum(n) OVER (PARTITION BY doc_id, o ORDER BY i) - n AS a FROM w),
e AS (SELECT *, CASE WHEN kind = 'iban' THEN list_max([l FOR l IN range(15, length(x) + 1) IF x[l] <> ' ' AND NOT regexp_matches((x || follows)[l + 1], '[\p{{L}}\p{{N}}]') AND length(replace(x[:l], ' ', '')) BETWEEN 15 AND 34
    AND list_reduce(list_concat([0], [CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END FOR c IN string_split(replace(x[5:l], ' ', '') || x[:4], '')]), lambda y, v: (y * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1]) ELSE length(x) END AS size
  FROM s WHERE i > 1),
f AS (SELECT doc_id, o, kind, a, kind || ':' || a || ':' || (a + size) AS span FROM e WHERE CASE kind
  WHEN 'ip' THEN len([q FOR q IN string_split(x, '.') IF length(ltrim(q, '0')) > 3 OR coalesce(TRY_CAST(ltrim(q, '0') AS INT), 0) > 255]) = 0
  WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum([CASE WHEN j % 2 = 1 THEN g ELSE 2 * g - 9 * (g > 4)::INT END FOR g, j IN [ascii(c) - 48 FOR c IN string_split(reverse(digits), '')]]) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  WHEN 'iban' THEN size IS NOT NULL
  WHEN 'secret' THEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')
  ELSE true END)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  sha256(coalesce(string_agg(span, ',' ORDER BY o, a) FILTER (o < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY o, a), '') AS spans, count(*) FILTER (o >= {len(BASE)}) AS n_added, count(span) AS n_spans
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""


ORACLE = _oracle()
