"""Candidate score and match confidence as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the candidate score, then of the confidence.
SCORE_AMOUNT, SCORE_DATE, SCORE_REFERENCE = 0.55, 0.25, 0.20
CONF_AMOUNT, CONF_DATE, CONF_REFERENCE, CONF_UNIQUE = 0.50, 0.20, 0.20, 0.10
UNIQUE_BOTH, UNIQUE_ONE, UNIQUE_NONE = 1.0, 0.6, 0.3
SMALLEST_BASE = 1e-9
MICROS_PER_DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    """Zone-less timestamp as microseconds since the epoch (exact, no double rounding)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def base_amount(amount: Column) -> Column:
    return F.greatest(F.abs(amount), F.lit(SMALLEST_BASE))


def relative_gap(amount_a: Column, amount_b: Column) -> Column:
    return F.abs(amount_b - amount_a) / base_amount(amount_a)


def amount_similarity(gap: Column, amount_a: Column) -> Column:
    return F.lit(1.0) - F.least(gap / base_amount(amount_a), F.lit(1.0))


def whole_days(micros_a: Column, micros_b: Column) -> Column:
    """Whole elapsed days between two instants, regardless of direction."""
    return F.floor(F.abs(micros_b - micros_a) / F.lit(MICROS_PER_DAY)).cast("int")


def date_score(days: Column, window_days: int) -> Column:
    inside = F.lit(0.7) + F.lit(0.3) * (F.lit(1.0) - days / F.lit(float(max(window_days, 1))))
    return F.when(days == 0, F.lit(1.0)).when(days <= window_days, inside).otherwise(F.lit(0.2))


def candidate_score(amount_sim: Column, date_part: Column, ref_sim: Column) -> Column:
    return SCORE_AMOUNT * amount_sim + SCORE_DATE * date_part + SCORE_REFERENCE * ref_sim


def round_half_up(value: Column, places: int) -> Column:
    """``floor(x * 10^n + 0.5) / 10^n``: the same bits in every engine that has IEEE doubles."""
    scale = F.lit(float(10 ** places))
    return F.floor(value * scale + F.lit(0.5)) / scale


def uniqueness(count_a: Column, count_b: Column) -> Column:
    return (
        F.when((count_a <= 1) & (count_b <= 1), F.lit(UNIQUE_BOTH))
        .when((count_a > 1) & (count_b > 1), F.lit(UNIQUE_NONE))
        .otherwise(F.lit(UNIQUE_ONE))
    )


def confidence(amount_sim: Column, date_part: Column, ref_sim: Column, unique: Column) -> Column:
    raw = CONF_AMOUNT * amount_sim + CONF_DATE * date_part + CONF_REFERENCE * ref_sim + CONF_UNIQUE * unique
    return round_half_up(F.greatest(F.lit(0.0), F.least(raw, F.lit(1.0))), 2)
