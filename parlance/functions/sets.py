"""Overlap measures of token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, none: float) -> Column:
    return F.when(b == 0, F.lit(none)).otherwise(a / F.greatest(b, F.lit(1)))


def shared(h: Column, r: Column) -> Column:
    """Number of different tokens in both."""
    return F.size(F.array_intersect(h, r))


def token_overlap(h: Column, r: Column) -> Column:
    """Share of the reference's different tokens that the hypothesis has; 0 without reference."""
    return _ratio(shared(h, r), F.size(F.array_distinct(r)), 0.0)


def content_overlap(h: Column, r: Column) -> Column:
    """Different shared tokens over all reference tokens, repeated ones counted; 1 without reference."""
    return _ratio(shared(h, r), F.size(r), 1.0)


def jaccard(h: Column, r: Column) -> Column:
    return F.when(F.size(r) == 0, 0.0).otherwise(shared(h, r) / F.greatest(F.size(F.array_union(h, r)), F.lit(1)))


def scaled(v: Column, most: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), v * most))


def error_counts(h: Column, r: Column) -> Column:
    """ref_tokens, hyp_tokens, matched, deletions, insertions, as the evaluator counts them."""
    m = shared(h, r)
    return F.struct(
        F.size(r).alias("ref_tokens"),
        F.size(h).alias("hyp_tokens"),
        m.alias("matched"),
        F.greatest(F.size(r) - m, F.lit(0)).alias("deletions"),
        F.greatest(F.size(h) - m, F.lit(0)).alias("insertions"),
    )
