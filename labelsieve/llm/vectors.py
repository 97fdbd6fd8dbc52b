"""Vectors of the embedding operators: which ones count, as integers, as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Integer components beyond this are refused: their products would not fit 64 bits.
LARGEST = 1 << 27
SCALE = 256


def finite(column: str) -> Column:
    """Whether the array is there and no component is null, NaN or infinite."""
    fine = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def integers(column: str) -> Column:
    """floor(256 * x) of each component, as bigint."""

    def one(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * SCALE)
        too_large = F.raise_error(F.lit(f"a component times {SCALE} is beyond {LARGEST}"))
        return F.when(F.abs(scaled) <= LARGEST, scaled).otherwise(too_large.cast("bigint"))

    return F.transform(column, one)


def lengths(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def inner(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as int64."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    largest = int(np.abs(left).max()) * int(np.abs(right).max()) * left.shape[1]
    if largest < 1 << 53:  # every partial sum is a whole number that a double holds
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if largest >= 1 << 63:
        raise ValueError("inner products beyond 64 bits")
    return left @ right.T
