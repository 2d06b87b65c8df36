"""Sequence alignment: token and character edit distance, longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import let

#: First code point of a token, and how many follow without the surrogates.
FIRST, SURROGATES, GAP, LAST = 0x100, 0xD800, 0x800, 0x10FFFF
LETTERS = LAST + 1 - FIRST - GAP
#: Shared tokens up to which a token is looked up one by one, letters up to which a distance has no bound, and the first bound.
FEW, SHORT, NEAR = 256, 64, 16


def _place(x: Column, words: Column, steps: Column) -> Column:
    """Place from 1 of x among the sorted words, by bisection; 0 if it isn't there."""
    at = F.aggregate(steps, F.lit(0), lambda a, step: F.when(F.get(words, a + step - 1) <= x, a + step).otherwise(a))
    return let(at, lambda a: F.when(F.get(words, a - 1) == x, a).otherwise(0))


def _code(place: Column, side: int) -> Column:
    """Number of the letter of a token: by its place among the shared words, and one of each side's own where that is 0."""
    return place + (FIRST + 1) if side else F.coalesce(F.nullif(place, F.lit(0)) + (FIRST + 1), F.lit(FIRST))


def _as_letters(t: Column, words: Column, steps: Column, side: int) -> Column:
    few = F.transform(t, lambda x: _code(F.array_position(words, x), side))
    many = F.transform(t, lambda x: let(_code(_place(x, words, steps), side), lambda c: c + F.when(c >= SURROGATES, GAP).otherwise(0)))
    codes = F.when(F.size(words) <= FEW, few).otherwise(many.cast("array<bigint>"))
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 8, "0")), "")), "UTF-32")


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two texts. Long ones are compared within a bound that grows fourfold until it holds: similar texts cost little."""

    def bounded(two: Column) -> Column:
        a, b = two["a"], two["b"]
        size = F.greatest(F.char_length(a), F.char_length(b))
        # the last bound is no less than the longer text
        bounds = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(NEAR)) / NEAR) / 2).cast("int")), lambda i: F.pow(F.lit(4), i).cast("int") * NEAR)
        grown = F.aggregate(bounds, F.lit(-1), lambda found, most: F.when(found >= 0, found).otherwise(F.call_function("levenshtein", a, b, most)))
        return F.when(size <= SHORT, F.levenshtein(a, b)).otherwise(grown)

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(a.alias("a"), b.alias("b")), bounded))


def token_edit_distance(h: Column, r: Column) -> Column:
    """Levenshtein distance of token arrays.

    Each token that both sides have becomes one letter, and those that only one side has become
    another letter for each side, as they equal nothing: so the built-in `levenshtein` does the work. Letters go
    on behind the surrogates; a row with more than a million (LETTERS) different
    words that both of its texts have is an error.
    """

    def encoded(words: Column) -> Column:
        steps = F.transform(F.sequence(F.floor(F.log2(F.size(words) + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
        d = let(steps, lambda s: distance(_as_letters(h, words, s, 0), _as_letters(r, words, s, 1)))
        return F.when(F.size(words) <= LETTERS - 2, d).otherwise(F.raise_error(F.lit("too many different shared tokens in a row")).cast("int"))

    return let(F.array_sort(F.array_intersect(h, r)), encoded)


def wer(h: Column, r: Column) -> Column:
    """Word error rate; null without reference words."""
    return F.when(F.size(r) > 0, token_edit_distance(h, r) / F.greatest(F.size(r), F.lit(1)))


def cer(h: Column, r: Column) -> Column:
    """Character error rate of texts; null without reference characters."""
    return F.when(F.char_length(r) > 0, distance(h, r) / F.greatest(F.char_length(r), F.lit(1)))


def lcs_of(a, b) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _lcs(h: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else lcs_of(a.tolist(), b.tolist()) for a, b in zip(h, r, strict=True)], dtype="Int32")


def lcs_udf():
    return F.pandas_udf(_lcs, T.IntegerType())


def lcs_length(h: Column, r: Column) -> Column:
    """Length of the longest common subsequence of token arrays (bit-parallel, in Arrow batches).

    Built-in functions can only express the quadratic table with an array copy for
    each cell; this takes a machine operation for each 64 cells.
    """
    return lcs_udf()(h, r)


def subsequence(h: Column, r: Column) -> Column:
    return lcs_length(h, r) / F.greatest(F.size(h), F.size(r), F.lit(1))
