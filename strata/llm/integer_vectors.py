"""Vectors as whole numbers, so that distances, sums and means are exact and do not depend on the order of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: components beyond this could give squared distances that no long holds
MOST = 1 << 27


def finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are numbers."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector.cast("array<double>"), fits), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as array<int>; a component beyond MOST is an error."""
    whole = lambda x: F.floor(x * F.lit(float(scale)))
    too_large = F.raise_error(F.lit(f"components must be within {MOST} after scaling")).cast("int")
    return F.transform(vector.cast("array<double>"), lambda x: F.when(F.abs(x * F.lit(float(scale))) <= F.lit(float(MOST)), whole(x).cast("int")).otherwise(too_large))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The list column as a matrix, a row for each list of ``width`` values."""
    off = column.offsets.to_numpy()
    return column.values.to_numpy()[off[0] : off[-1]].reshape(len(column), width)
