"""Columns that the optimiser works out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns added or replaced, as output of a one-row generator.

    Filters aren't pushed below a generator and projections aren't merged across it, so an expression that later ones use
    often isn't repeated in each of them.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value worked out once: inside a lambda an expression is worked out again wherever it stands."""
    return F.get(F.transform(F.array(value), of), F.lit(0))
