"""Scalar score expressions (cumulative, class, direction, adjusted, display)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.config import (
    ESG_LABEL,
    NEGATIVE_THRESHOLD,
    NON_ESG_LABEL,
    NOT_DETECTED,
    POSITIVE_THRESHOLD,
)
from tidings.functions.text import col_, let


def no_nan(x: Column | str) -> Column:
    """NaN -> null: Spark orders NaN above every number, Python compares it false."""
    return F.nanvl(col_(x).cast("double"), F.lit(None).cast("double"))


def cumulative(positive: Column | str, negative: Column | str) -> Column:
    """positive - negative, a missing score counts as 0."""
    return F.coalesce(col_(positive), F.lit(0.0)) - F.coalesce(col_(negative), F.lit(0.0))


def sentiment_class(score: Column | str, pos: float = POSITIVE_THRESHOLD, neg: float = NEGATIVE_THRESHOLD) -> Column:
    """Strict thresholds: exactly +/-0.5 is Neutral; NaN and null are Neutral."""
    s = no_nan(score)
    return F.when(s > pos, "Positive").when(s < neg, "Negative").otherwise("Neutral")


def direction(positive: Column | str, negative: Column | str) -> Column:
    """+1 when positive > negative, else -1 (never 0: ties go to -1)."""
    p = F.coalesce(no_nan(positive), F.lit(0.0))
    n = F.coalesce(no_nan(negative), F.lit(0.0))
    return F.when(p > n, F.lit(1)).otherwise(F.lit(-1))


def adjusted(direction_col: Column, materiality: Column | str) -> Column:
    """direction x materiality; adding 0.0 turns -0.0 into 0.0."""
    return direction_col.cast("double") * col_(materiality) + F.lit(0.0)


def clamp(x: Column | str, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col_(x)))


def argmax_label(positive: Column | str, negative: Column | str, neutral: Column | str) -> Column:
    """Label of the highest score; ties resolved positive, negative, neutral."""
    p, n, u = col_(positive), col_(negative), col_(neutral)
    return (F.when((p >= n) & (p >= u), "positive")
            .when(n >= u, "negative")
            .otherwise("neutral"))


def company_display(company: Column | str) -> Column:
    return F.coalesce(col_(company), F.lit(NOT_DETECTED))


def esg_display(flag: Column | str) -> Column:
    return F.when(col_(flag), ESG_LABEL).otherwise(NON_ESG_LABEL)


def _fixed(x: Column, decimals: int) -> Column:
    """``abs(x)`` with ``decimals`` places, rounded half to even on the exact
    binary value (a format function rounds the shortest printed digits).

    ``x * 10**decimals`` is taken as a rounded product and its exact error
    (the factor is small, so splitting x in two halves is enough); the error
    decides next to a tie, and at a tie the even neighbour wins.
    """
    unit = 10 ** decimals
    scale = float(unit)

    def parts(v: Column) -> Column:
        big = v * F.lit(134217729.0)  # 2**27 + 1: the upper half of the digits
        high = big - (big - v)
        product = v * F.lit(scale)
        return F.struct(product.alias("p"), ((high * scale - product) + (v - high) * scale).alias("e"), F.floor(product).alias("n"))

    def text(t: Column) -> Column:
        over = (t["p"] - t["n"].cast("double") - F.lit(0.5)) + t["e"]
        up = (over > 0) | ((over == 0) & (t["n"] % 2 == 1))
        return let(t["n"] + up.cast("long"), lambda n: F.concat(F.floor(n / F.lit(unit)).cast("string"), F.lit("."),
                                                               F.lpad((n % F.lit(unit)).cast("string"), decimals, "0")))

    return let(parts(F.abs(x)), text)


def signed(x: Column | str, decimals: int) -> Column:
    """Fixed-decimal text with an explicit sign, like ``f"{x:+.4f}"``."""
    v = col_(x).cast("double")
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("+")), F.when(F.isnan(v), F.lit("nan")).otherwise(_fixed(v, decimals)))


def unsigned(x: Column | str, decimals: int) -> Column:
    v = col_(x).cast("double")
    return F.when(F.isnan(v), F.lit("nan")).otherwise(F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), _fixed(v, decimals)))


def half_up(x: Column, digits: int) -> Column:
    """``F.round`` of a double, bit for bit. ``F.round`` goes through decimal text, about a
    microsecond a value; away from a tie the nearest whole number of units, divided
    once, is the same double. Near a tie, and for large or odd values, ``F.round`` itself decides."""
    scaled = x * F.lit(float(10 ** digits))
    sure = (F.abs(scaled) < F.lit(1e9)) & (F.abs(F.abs(scaled - F.rint(scaled)) - F.lit(0.5)) > F.lit(1e-6))
    return F.when(sure, F.rint(scaled) / F.lit(float(10 ** digits)) + F.lit(0.0)).otherwise(F.round(x, digits))
