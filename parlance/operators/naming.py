"""Column names that stay out of a caller's way."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """For each name, one that none of the taken ones equals, whatever their case."""
    used, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def but(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """The columns of `df`, without those of these names."""
    gone = {n.lower() for n in names}
    return [col(c) for c in df.columns if c.lower() not in gone]


def replaced(columns: Iterable[str], new: dict[str, Column]) -> list[Column]:
    """All columns: a new one takes the place of the one of its name, once; the others follow at the end."""
    left = {n.lower(): (n, c) for n, c in new.items()}
    out = []
    for c in columns:
        n, value = left.pop(c.lower(), (c, None))
        if value is not None:
            out.append(value.alias(n))
        elif c.lower() not in {x.lower() for x in new}:
            out.append(col(c))
    return out + [value.alias(n) for n, value in left.values()]
