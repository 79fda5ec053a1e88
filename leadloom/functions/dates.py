"""Recency and timestamp parsing; ``as_of`` is always given, never the clock."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.numbers import steps

# fixed values: (days, score), first reached bound wins
_RFM_DAYS = [(90, 5.0), (180, 4.5), (365, 4.0), (730, 3.0), (1095, 2.0), (1825, 1.5)]
_UNIFIED_DAYS = [(90, 15.0), (180, 12.0), (365, 9.0), (730, 6.0), (1825, 3.0)]
_FREQUENCY = [(7, 5.0), (5, 4.5), (4, 4.0), (3, 3.0), (2, 2.0)]
_MONETARY = [(0.95, 5.0), (0.85, 4.5), (0.75, 4.0), (0.60, 3.0), (0.45, 2.0), (0.35, 1.5)]
_CROSS = [(6, 20.0), (5, 18.0), (4, 15.0), (3, 10.0), (2, 6.0)]


def _by_age(ts: Column, as_of: str, table: list, older: float, unknown: float) -> Column:
    days = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp"))
                    - F.unix_timestamp(ts.cast("timestamp"))) / F.lit(86400))
    out = F.when(ts.isNull(), F.lit(unknown))
    for bound, score in table:
        out = out.when(days <= bound, F.lit(score))
    return out.otherwise(F.lit(older))


def rfm_recency(ts: Column, as_of: str) -> Column:
    return _by_age(ts, as_of, _RFM_DAYS, 1.0, 1.0)


def unified_recency(ts: Column, as_of: str) -> Column:
    return _by_age(ts, as_of, _UNIFIED_DAYS, 0.0, 5.0)


def rfm_frequency(source_count: Column) -> Column:
    return steps(source_count, _FREQUENCY, 1.0)


def rfm_monetary(source_weight: Column) -> Column:
    return steps(source_weight, _MONETARY, 1.0)


def cross_source(source_count: Column) -> Column:
    return steps(source_count, _CROSS, 2.0)


def within_days(ts: Column, as_of: str, days: int = 7) -> Column:
    """True for events of the last ``days`` days before ``as_of``."""
    cutoff = F.expr(f"timestamp'{as_of}' - INTERVAL {int(days)} DAYS")
    return F.coalesce(ts.cast("timestamp") >= cutoff, F.lit(False))


def chat_timestamp(text: Column) -> Column:
    """'dd/MM HH:mm', ISO or 'HH:mm'; texts without a date share one base day."""
    return F.coalesce(
        F.try_to_timestamp(F.concat(F.lit("1900/"), F.trim(text)), F.lit("yyyy/d/M H:m")),
        F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(F.concat(F.lit("1900-01-01 "), F.trim(text)), F.lit("yyyy-MM-dd H:m")),
    )
