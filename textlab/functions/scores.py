"""Score expressions: softmax, argmax, sigmoid over logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def prob_class1(z0: Column | str, z1: Column | str) -> Column:
    """Softmax over two logits, probability of class 1."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(z0) - _c(z1)))


def argmax2(z0: Column | str, z1: Column | str) -> Column:
    """Index of the larger logit; a tie goes to class 0."""
    return F.when(_c(z1) > _c(z0), F.lit(1)).otherwise(F.lit(0))


def argmax_k(z: Column | str) -> Column:
    """0-based index of the first maximum of an array of logits."""
    arr = _c(z)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def softmax_k(z: Column | str) -> Column:
    """ARRAY<DOUBLE> softmax with max subtraction for stability."""
    arr = F.transform(_c(z), lambda x: x.cast("double"))
    m = F.array_max(arr)
    ex = F.transform(arr, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)
