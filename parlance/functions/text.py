"""Text normalisation and tokens: Column -> Column, no Python on the executors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import lexicon

SPACE = r"(?U)\s+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row: inside a lambda over another array, it would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def text(c: Column) -> Column:
    """Null is the empty text."""
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, " ")


def normalized(c: Column) -> Column:
    """Lower case without punctuation, single spaces; accents stay."""
    return stripped(collapsed(F.regexp_replace(F.lower(text(c)), r"(?U)[^\p{L}\p{N}_\s]", "")))


def tokens(c: Column) -> Column:
    return F.filter(F.split(text(c), SPACE), lambda t: t != "")


def lower_tokens(c: Column) -> Column:
    """Tokens of the lower-cased text, punctuation kept."""
    return tokens(F.lower(text(c)))


def lower_stripped(c: Column) -> Column:
    return stripped(F.lower(text(c)))


def strings(words) -> Column:
    return F.array(*map(F.lit, words))


def content_words(t: Column, stop=lexicon.FUNCTION_WORDS) -> Column:
    """Tokens that aren't in the list, repeated ones kept."""
    return F.filter(t, lambda x: ~x.isin(list(stop)))


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def sample_id(place: Column) -> Column:
    return F.format_string("sample_%03d", place)


def postprocessed(c: Column, *, lowercase=True, punctuation=True, disfluencies=True, substitutions=True, whitespace=True) -> Column:
    """Clean a transcription; blank text becomes empty.

    Order: lower case, punctuation, disfluencies, substitutions, white space.
    """
    x = text(c)
    x = F.lower(x) if lowercase else x
    if punctuation:
        x = F.replace(F.regexp_replace(F.regexp_replace(x, r"[.!?]+$", ""), "[—–-]+", " "), F.lit(","), F.lit(""))
    if disfluencies:
        # one alternation, from the left: what an earlier match takes is no part of another
        x = F.regexp_replace(x, f"(?iU){'|'.join(lexicon.DISFLUENCIES)}", " ")
    if substitutions:
        x = reduce(lambda y, rule: F.regexp_replace(y, f"(?iU){rule[0]}", rule[1]), lexicon.SUBSTITUTIONS, x)
    x = collapsed(x) if whitespace else x
    return F.when(stripped(text(c)) == "", "").otherwise(stripped(x))


def explained(raw: Column, processed: Column) -> Column:
    """removed, added and unchanged tokens, each sorted without repetition; raw is lower-cased."""
    a, b = lower_tokens(raw), tokens(processed)
    return F.struct(
        F.array_sort(F.array_except(a, b)).alias("removed"),
        F.array_sort(F.array_except(b, a)).alias("added"),
        F.array_sort(F.array_intersect(a, b)).alias("unchanged"),
    )
