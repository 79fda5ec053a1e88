"""Arithmetic that gives the same result in every partitioning and run order."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, places: int) -> Column:
    """Round half-up on the decimal value, so 2.675 -> 2.68."""
    return F.round(value.cast("decimal(38,10)"), places).cast("double")


def exact_sum(value: Column) -> Column:
    """Order-independent sum of money or rates (micro-unit decimals)."""
    return F.sum(value.cast("decimal(28,6)"))


def exact_avg(value: Column, places: int) -> Column:
    """Mean of the non-null values, computed from an exact sum."""
    return half_up(ratio(exact_sum(value), F.count(value)), places)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 when the denominator is empty."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def rate(num: Column, den: Column, places: int, scale: float = 1.0) -> Column:
    """Rounded safe ratio: cost per lead, conversion rate, cpm, ctr, share."""
    return half_up(ratio(num, den) * F.lit(float(scale)), places)


def steps(value: Column, bounds: list[tuple[float, float]], below: float) -> Column:
    """First score whose lower bound the value reaches, ``below`` otherwise."""
    out = None
    for bound, score in bounds:
        cond = value >= F.lit(bound)
        out = F.when(cond, F.lit(score)) if out is None else out.when(cond, F.lit(score))
    return out.otherwise(F.lit(below))


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), value))


def rescale(value: Column, lo: float, hi: float) -> Column:
    """(v - lo) / (hi - lo + 1) clipped to 0..1."""
    return clip((value.cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo + 1)), 0.0, 1.0)


def rating(value: Column, good: float, medium: float, higher_is_better: bool) -> Column:
    """good / medium / poor of a metric against its two thresholds."""
    if higher_is_better:
        is_good, is_medium = value >= F.lit(good), value >= F.lit(medium)
    else:
        is_good, is_medium = value <= F.lit(good), value <= F.lit(medium)
    return F.when(is_good, "good").when(is_medium, "medium").otherwise("poor")
