"""Folds over one row's short array: SQL higher-order functions, no Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_by_key(values: Column, key) -> Column:
    """values in order, each kept if no earlier one has the same key."""
    empty = F.filter(values, lambda _: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda y: key(y) == key(x)), kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(values, empty, step)
