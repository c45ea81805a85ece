"""Preparing waveforms, as array expressions: one array of samples a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once: an expression named inside a lambda is otherwise computed for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _doubles(signal: Column) -> Column:
    return F.transform(signal, lambda x: x.cast("double"))


def resampled(signal: Column, rate: int, wanted: int) -> Column:
    """The signal at another rate: floor(n * wanted / rate) samples at even places from the first to the last, interpolated between neighbours; one wanted sample is the first."""

    def of(x: Column) -> Column:
        n, m = F.size(x), F.floor(F.size(x) * F.lit(wanted) / F.lit(rate)).cast("int")

        def at(i: Column) -> Column:
            place = F.when(m > 1, i * (n - 1) / (m - 1)).otherwise(0.0)
            low = F.least(F.floor(place).cast("int"), n - 1)
            first = F.get(x, low)
            return first + (F.get(x, F.least(low + 1, n - 1)) - first) * (place - low)

        return F.when(m > 0, F.transform(F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1), at)).when(m == 0, F.array().cast("array<double>"))

    return let(_doubles(signal), of)


def constant_zeroed(signal: Column) -> Column:
    """Zeros in place of a signal of one value."""
    return let(_doubles(signal), lambda x: F.when(F.array_min(x) == F.array_max(x), F.transform(x, lambda _: F.lit(0.0))).otherwise(x))


def standardised(signal: Column) -> Column:
    """Less its mean, over its standard deviation (of the population); a constant signal is zeros."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v)
    scaled = lambda moved: let(F.sqrt(total(F.transform(moved, lambda v: v * v)) / F.size(moved)), lambda d: F.transform(moved, lambda v: F.when(d > 0, v / d).otherwise(0.0)))
    centred = lambda x: let(total(x) / F.size(x), lambda mean: let(F.transform(x, lambda v: v - mean), scaled))
    return let(_doubles(signal), lambda x: F.when(F.size(x) > 0, centred(x)).otherwise(x))


def segments(signal: Column, length: int) -> Column:
    """Whole runs of `length` samples, one after the other; a shorter rest is left out."""

    def of(x: Column) -> Column:
        k = F.floor(F.size(x) / length).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda i: F.slice(x, i * length + 1, F.lit(length)))
        return F.when(k > 0, cut).when(k == 0, F.slice(cut, 1, 0))

    return let(signal, of)
