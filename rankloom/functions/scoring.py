"""Row-wise scoring expressions: rank discounts and blends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, mul

from pyspark.sql import Column
from pyspark.sql import functions as F

WAYS = ("mean", "geom", "harmonic")


def discounted(gain: Column, position: Column, method: int = 0) -> Column:
    """A gain over its rank discount; method 0 leaves position 1 undivided, method 1 uses log2(p + 1)."""
    if method == 0:
        return gain / F.when(position == 1, F.lit(1.0)).otherwise(F.log2(position))
    if method == 1:
        return gain / F.log2(position + 1)
    raise ValueError(f"no discount method {method!r}")


def blend_mean(preds: Sequence[Column]) -> Column:
    return reduce(add, preds) / F.lit(float(len(preds)))


def blend_geom(preds: Sequence[Column]) -> Column:
    return F.pow(F.abs(reduce(mul, preds)), F.lit(1.0 / len(preds)))


def blend_harmonic(preds: Sequence[Column]) -> Column:
    """m over the sum of reciprocals, with the limits floating-point arithmetic gives.

    A zero among the inputs gives 0; reciprocals that cancel give infinity, so
    that such a blend cannot win on a row it has no finite score for.
    """
    total = reduce(add, [F.try_divide(F.lit(1.0), p) for p in preds])
    any_zero = reduce(lambda a, b: a | b, [p == 0 for p in preds])
    any_null = reduce(lambda a, b: a | b, [p.isNull() for p in preds])
    return (
        F.when(any_null, F.lit(None).cast("double"))
        .when(any_zero, F.lit(0.0))
        .when(total == 0, F.lit(float("inf")))
        .otherwise(F.try_divide(F.lit(float(len(preds))), total))
    )


def blend(preds: Sequence[Column], way: str) -> Column:
    return {"mean": blend_mean, "geom": blend_geom, "harmonic": blend_harmonic}[way](preds)
