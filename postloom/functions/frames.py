"""DataFrame helpers that shape the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A filter on a plain derived column is pushed below it with the whole expression copied into
    the filter, once per use. Costly expressions (long regex chains) go through a one-row
    generator instead, which filters do not cross.
    """
    named = [c.alias(name) for name, c in columns.items()]
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*named))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it, also inside a condition."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
