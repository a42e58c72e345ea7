"""Dense vectors in array columns.

Cosine distance always divides by the norms: stored vectors need not have unit
length. A zero vector has distance NaN, which sorts after every number.
Distances are kept at nine decimals, so that equal vectors tie exactly however
a sum was ordered, and the id breaks the tie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS = 1_000_000_000
NAN_UNITS = 2 * UNITS + 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """Distance of two vector columns of one row, all in the JVM."""
    cosine = F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(float("nan")))
    return F.abs(F.round(1 - cosine, 9))


def similarity(distance: Column) -> Column:
    return F.round(1 - distance, 5)


def l2_normalize(v: Column) -> Column:
    """Unit-length copy; a zero vector stays zero."""
    # The length is zipped in: inside a lambda it would be summed anew for every value.
    lengths = F.array_repeat(norm(v), F.size(v))
    return F.zip_with(v, lengths, lambda x, length: F.when(length == 0, 0.0).otherwise(x.cast("double") / length))


def dimension(v: Column) -> Column:
    return F.size(v)


def constant_vector(value: Column, size: int) -> Column:
    return F.array_repeat(value, size)


@F.arrow_udf(T.StringType())
def _formatted(column: pa.Array) -> pa.Array:
    texts = []
    for values in column.to_pylist():
        texts.append(None if values is None else "[" + ",".join(["%.8f"] * len(values)) % tuple(values) + "]")
    return pa.array(texts, pa.string())


def vector_to_text(v: Column) -> Column:
    """``[0.10000000,...]``, eight decimals, rounded as Python (not Java) rounds."""
    return _formatted(v)


def text_to_vector(text: Column) -> Column:
    return F.from_json(text, T.ArrayType(T.DoubleType()))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column as one float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    if column.null_count:
        raise ValueError("a vector is NULL; reject such rows first")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.size % len(column):
        raise ValueError("vectors differ in length; reject such rows first")
    width = flat.size // len(column)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError("vectors differ in length; reject such rows first")
    return flat.reshape(len(column), width)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row becomes NaN."""
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return vectors / lengths


def distance_units(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances of unit rows as whole billionths."""
    distance = np.clip(1.0 - a @ b.T, 0.0, 2.0)
    missing = np.isnan(distance)
    distance[missing] = 0.0
    units = np.rint(distance * UNITS).astype(np.int64)
    units[missing] = NAN_UNITS
    return units


def units_to_distance(units: np.ndarray) -> np.ndarray:
    return np.where(units >= NAN_UNITS, np.nan, units / UNITS)


def distance_to(vector) -> callable:
    """An Arrow function of one vector column: its distance to a fixed vector."""
    target = unit_rows(np.asarray(vector, dtype=np.float64).reshape(1, -1))

    @F.arrow_udf(T.DoubleType())
    def distance(column: pa.Array) -> pa.Array:
        if len(column) == 0:
            return pa.array([], pa.float64())
        return pa.array(units_to_distance(distance_units(unit_rows(matrix(column)), target)[:, 0]), from_pandas=False)

    return distance
