"""Folds over the ordered rows of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], values: list[str], start: Column, step: Callable[[Column, Column], Column], out: str, reverse: bool = False) -> DataFrame:
    """One row for each key: ``step`` applied from ``start`` to the rows in order. A key's rows are held in one array, so
    callers reduce them first (to sessions, to counts) and pass only the columns the step needs."""
    rows = F.collect_list(F.struct(*order, *values))
    rows = F.sort_array(rows, asc=not reverse)
    return df.groupBy(*keys).agg(F.aggregate(rows, start, step).alias(out))
