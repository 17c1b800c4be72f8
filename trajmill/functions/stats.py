"""Closed forms of the metrics: no binomial coefficient is ever formed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n-c, k) / C(n, k): a product with min(c, k) factors."""
    by_correct = (c <= k)
    terms = F.when(by_correct, c).otherwise(k).cast("int")
    other = F.when(by_correct, k).otherwise(c).cast("double")
    steps = F.sequence(F.lit(0), F.greatest(terms - 1, F.lit(0)))

    def factor(fail: Column, j: Column) -> Column:
        return fail * F.greatest(1 - other / (n - j), F.lit(0.0))

    return F.when(terms <= 0, 0.0).otherwise(1 - F.aggregate(steps, F.lit(1.0), factor))


def none_better(n: Column, rank: Column, first: int, size: int) -> Column:
    """One stretch of the chance that the other drawn rows all rank below the row of
    0-based ``rank``: the factors of draws ``first`` to min(size, n) - 1.

    Over all stretches from 1 the product is C(n-1-rank, m-1) / C(n-1, m-1).
    """
    last = F.least(F.lit(size), n) - 1
    draws = F.sequence(F.lit(first), F.greatest(last, F.lit(first)).cast("int"))

    def factor(chance: Column, d: Column) -> Column:
        return chance * F.greatest((n - rank - d) / (n - d), F.lit(0.0))

    return F.when(last < first, 1.0).otherwise(F.aggregate(draws, F.lit(1.0), factor))


def histogram_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of ``value`` among equal bins of [low, high], the last one closed.

    A single-valued range is widened by half a unit on both sides.
    """
    flat = high == low
    start = F.when(flat, low - 0.5).otherwise(low)
    width = F.when(flat, F.lit(1.0)).otherwise(high - low)
    return F.least(F.floor((value - start) / width * bins), F.lit(bins - 1)).cast("int")


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
