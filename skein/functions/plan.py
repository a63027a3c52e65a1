"""Helpers that keep plans small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``df.select(keep, columns)``, such that later filters on ``columns`` are not pushed below it.

    A filter pushed through a projection repeats the column's whole expression for every mention,
    and through several projections of nested conditionals the plan grows exponentially. The columns
    pass through a one-row generator instead, which costs nothing else.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*keep, F.inline_outer(one))
