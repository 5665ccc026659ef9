"""Scalar column programs: tolerant casts, clamps, categories and tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column, digits: int = 6) -> Column:
    """Round half up with a nudge, so that engines that sum in another order agree."""
    return F.round(c + F.lit(1e-9), digits)


def share(condition: Column) -> Column:
    """Mean of a condition over all rows (null counts as false), as a double."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def n_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def clean_text(c: Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def clean_double(c: Column) -> Column:
    return clean_text(c).try_cast("double")


def clean_int(c: Column) -> Column:
    """Through double, so "14.0" is 14; unparsable is null."""
    return clean_double(c).try_cast("int")


def clean_long(c: Column) -> Column:
    return F.coalesce(clean_text(c).try_cast("bigint"), clean_double(c).try_cast("bigint"))


def clean_date(c: Column) -> Column:
    """yyyymmdd of exactly eight characters that is a real date."""
    t = F.trim(c)
    return F.when(F.length(t) == 8, F.try_to_date(t, "yyyyMMdd"))


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def category(root: Column, base: Column, quad: Column) -> Column:
    """One of five categories, by priority; null root is diplomatic."""
    return (
        F.when(root.isNull(), "diplomatic")
        .when((quad == 4) & (base.between(180, 186) | root.isin(18, 20)), "terrorism")
        .when(base.isin(163, 168, 172, 173), "sanctions")
        .when(root.isin(15, 16, 17, 19, 20) & quad.isin(3, 4), "military")
        .when(root == 14, "protest")
        .otherwise("diplomatic")
    )


#: Lower bounds of risk tiers.
TIERS = ((0.80, "CRITICAL"), (0.65, "HIGH"), (0.50, "ELEVATED"), (0.35, "MODERATE"))


def risk_tier(score: Column, unknown_when_zero: bool = False) -> Column:
    tier = F.lit("LOW")
    for bound, name in reversed(TIERS):
        tier = F.when(score >= bound, name).otherwise(tier)
    return F.when(score.isNull() | (score == 0), "UNKNOWN").otherwise(tier) if unknown_when_zero else tier


def level_bin(c: Column) -> Column:
    """0 to 3 at .25, .50 and .75."""
    return F.when(c >= 0.75, 3).when(c >= 0.5, 2).when(c >= 0.25, 1).otherwise(0)


def composite(instability: Column, war: Column, terrorism: Column, financial: Column, weights=(0.4, 0.3, 0.2, 0.1)) -> Column:
    a, b, c, d = map(F.lit, weights)
    return F.least(F.greatest(a * instability + b * war + c * terrorism + d * financial, F.lit(0.0)), F.lit(1.0))


def trend(delta: Column, band: float) -> Column:
    return F.when(delta > band, "increasing").when(delta < -band, "decreasing").otherwise("stable")
