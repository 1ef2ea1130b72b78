"""Vector functions over arrays of numbers, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b of unit vectors."""
    return 1 - dot(a, b)


def normalised(v: Column) -> Column:
    """Unit length; a length below 1e-12 counts as that."""
    d = v.cast("array<double>")
    return F.transform(d, lambda x: x / F.greatest(F.sqrt(dot(d, d)), F.lit(1e-12)))


def truncated(v: Column, n: int) -> Column:
    """The first n components, at unit length again."""
    return normalised(F.slice(v, 1, n))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
