"""Column functions over number arrays: distances, and 64-bit hashes of 64 values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAR = 999.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 999 for empty vectors, different lengths or a zero norm."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), FAR).when(norm <= 0, FAR).otherwise(1 - dot(a, b) / F.when(norm > 0, norm))


def hash64(values: Column, level: Column) -> Column:
    """Bit k is set where the k-th of 64 values is above the level; the first value is the highest bit."""
    bits = F.transform(values, lambda v, k: F.when(v > level, F.call_function("shiftleft", F.lit(1).cast("long"), (63 - k).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def avg_hash64(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return hash64(F.transform(values, lambda v: v.cast("double")), total / F.size(values))


def median_hash64(values: Column) -> Column:
    ordered, n = F.array_sort(F.transform(values, lambda v: v.cast("double"))), F.size(values)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return hash64(F.transform(values, lambda v: v.cast("double")), (low + high) / 2)


def hash_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    return F.coalesce(1 - hash_distance(a, b) / bits, F.lit(0.0))
