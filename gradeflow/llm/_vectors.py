"""Integer vectors for the operators that have to be exact: scaling in the JVM, products whose number type can't overflow."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled components are held at this size at most, so that any squared distance of 64 components fits into 38 digits.
MOST = 2.0**59


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a long, held at ``MOST``; null for a null vector or one with a null, NaN or infinite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(wide, lambda x: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), x * F.lit(float(scale))))))
    return F.when(~bad, scaled)


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """The lists of a column, all of one size, as the rows of a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), size)


def exact_type(*arrays: np.ndarray) -> type:
    """The number type in which squared distances of these rows are exact: doubles below 2**53, else 64-bit integers, else Python's."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    bound = max(a.shape[1] for a in arrays) * (2 * max(most, 1)) ** 2
    return float if bound < 2**53 else np.int64 if bound < 2**63 else object


#: A number above every squared distance, by type.
BEYOND = {float: np.inf, np.int64: np.iinfo(np.int64).max, object: 2**200}


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two matrices of one exact type."""
    return (left * left).sum(1)[:, None] - 2 * (left @ right.T) + (right * right).sum(1)[None, :]


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """Exact numbers of any of these types as Python's integers."""
    return values if values.dtype == object else values.astype(np.int64).astype(object)


def decimals(values: np.ndarray) -> pa.Array:
    """Exact numbers of any of these types as decimal(38, 0)."""
    if values.dtype == object:
        return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
    return pa.array(values.astype(np.int64)).cast(pa.decimal128(38, 0))


def as_long(c: Column) -> Column:
    """A decimal as a long; null where it doesn't fit."""
    return c.try_cast("bigint")
