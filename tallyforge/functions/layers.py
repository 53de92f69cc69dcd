"""Values that are worked out once.

Catalyst merges projections, and an expression that a lambda refers to is then
worked out again for each element. ``let`` binds a value inside an expression;
``computed`` puts columns behind a generator of one row, which projections are
not merged across.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with these columns, replacing its own of the same names."""
    temporary = {n: f"_new_{i}" for i, n in enumerate(columns)}
    out = df.select("*", F.inline(F.array(F.struct(*(c.alias(temporary[n]) for n, c in columns.items())))))
    return out.drop(*columns).withColumnsRenamed({t: n for n, t in temporary.items()})
