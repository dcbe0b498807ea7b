"""Vector functions as Columns over array<float> or array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def sq8(v: Column) -> Column:
    """Components as whole numbers from -127 to 127, halves away from zero."""
    return F.transform(v, lambda x: F.round(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x.cast("double") * 127))).cast("int"))


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def signs(v: Column) -> Column:
    """1 where a component is at least 0, else 0."""
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(0))


def packed_signs(v: Column, dim: int) -> Column:
    """Signs as 64-bit numbers, component 64 w + i as bit i of number w."""
    words = [
        F.aggregate(F.transform(F.slice(v, 64 * w + 1, 64), lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
        for w in range(-(-dim // 64))
    ]
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
