"""Evaluate an expensive expression once, whatever reads it later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row ``inline``.

    A plain projection is merged into whatever follows: a filter on its result is pushed below it
    and evaluates the expression a second time, and every further reference repeats it in the
    generated code. Nothing is pushed or merged through a generator's own output, and the generator
    itself is part of whole-stage code generation. Use it only for columns read several times;
    unread ones are not pruned.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
