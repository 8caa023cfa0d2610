"""Columns computed once.

A filter on a projected column is pushed down with the column's definition copied into it.  Through
a chain of projections that share terms the copies multiply.  A column that comes out of a
one-element ``inline`` stays a column: filters on it run above, all others still go down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """Adds the columns of the last stage; earlier stages only hold its shared terms."""
    *shared, last = stages
    base = [c for c in df.columns if c not in last]
    for stage in shared:
        df = df.withColumns(stage)
    row = F.struct(*[value.alias(name) for name, value in last.items()])
    return df.select(*base, F.inline(F.array(row)))
