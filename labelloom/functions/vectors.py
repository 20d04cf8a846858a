"""Arithmetic on ARRAY<DOUBLE> columns, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.text import once


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def add(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b)


def first_argmax(vector: Column) -> Column:
    """Zero-based position of the largest entry; the first one on ties."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def softmax(logits: Column, denominator_floor: float = 0.0) -> Column:
    """Row softmax, shifted by the maximum so that it cannot overflow."""

    def normalise(exps: Column) -> Column:
        return once(
            total(exps) + F.lit(denominator_floor),
            lambda z: F.transform(exps, lambda e: e / z),
        )

    def shifted(x: Column) -> Column:
        exps = once(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
        return once(exps, normalise)

    return once(logits, shifted)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def entropy(vector: Column, floor: float = 1e-15) -> Column:
    return -F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * F.log(x + F.lit(floor)))


def tied_at_top(vector: Column, tolerance: float) -> Column:
    """True when more than one entry lies within ``tolerance`` of the largest."""
    top = F.array_max(vector)
    return F.size(F.filter(vector, lambda x: F.abs(x - top) < F.lit(tolerance))) > 1
