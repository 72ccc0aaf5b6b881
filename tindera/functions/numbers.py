"""Numbers out of display text, and scores.  Column functions; all are null-safe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of a risk fraction: from these values on.
HIGH, MODERATE = 0.61, 0.31
MISREAD_PESO = "â‚±"  # a peso sign whose bytes were read in another encoding


def risk_fraction(score: Column) -> Column:
    """A risk score as 0..1: what isn't a number is 0, above 1 it is a percentage, and it is clamped."""
    x = F.nanvl(F.coalesce(score.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(x > 1, x / 100).otherwise(x)))


def risk_fraction_of_percent(score: Column) -> Column:
    """The variant for scores that are known to be 0..100: it never mistakes 1 per cent for 100."""
    x = F.coalesce(score.try_cast("double"), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / 100))


def risk_level(score: Column) -> Column:
    x = risk_fraction(score)
    return F.when(x >= HIGH, "High").when(x >= MODERATE, "Moderate").otherwise("Low")


# The notice of each level.
ALERTS = {
    "High": "Not recommended — strong counterfeit or defect indicators detected",
    "Moderate": "Review carefully — moderate risk indicators detected",
    "Low": "Lower risk — fewer defect indicators detected in this sample",
}


def alert_text(score: Column) -> Column:
    level = risk_level(score)
    return F.when(level == "High", ALERTS["High"]).when(level == "Moderate", ALERTS["Moderate"]).otherwise(ALERTS["Low"])


def reliability(score: Column, positive: Column | None = None) -> Column:
    """100 less the risk; with a positive share, that share less the risk.  To one digit, half to even."""
    risk = risk_fraction(score)
    alone = 100 * (1 - risk)
    if positive is None:
        return round_half_even(alone, 1)
    share = F.coalesce(positive.try_cast("double"), F.lit(0.0))
    share = F.least(F.lit(1.0), F.when(share > 1, share / 100).otherwise(share))
    return round_half_even(F.when(positive.isNull(), alone).otherwise(100 * F.greatest(F.lit(0.0), share - risk)), 1)


def price_value(text: Column) -> Column:
    """The mean of the first two numbers in a price text; null if there is none."""
    numbers = F.transform(F.slice(F.regexp_extract_all(F.replace(text, F.lit(MISREAD_PESO), F.lit("₱")), F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1)), 1, 2), lambda n: F.regexp_replace(n, ",", "").cast("double"))
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x) / F.size(numbers))


def rating_value(value: Column) -> Column:
    """A rating of 0 to 5, else null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & x.between(0, 5), x)


def compact_number(text: Column) -> Column:
    """Counts such as 1,234, 1.2K or 1,2k.  All k, m, b count as letters of the number, so words can spoil it (then 0)."""
    kept = F.regexp_replace(text, r"[^0-9.,kmbKMB]", "")
    return _scaled(F.lower(F.regexp_extract(kept, r"([kmbKMB])$", 1)), F.regexp_replace(kept, r"[kmbKMB]$", ""))


def leading_compact_number(text: Column) -> Column:
    """The first number of a text, with a k, m or b right after it."""
    pattern = r"(?i)([0-9][0-9,.]*)\s*([kmb])?"
    return _scaled(F.lower(F.regexp_extract(text, pattern, 2)), F.regexp_extract(text, pattern, 1))


def _scaled(suffix: Column, number: Column) -> Column:
    comma_is_point = (suffix != "") & number.contains(",") & ~number.contains(".")
    plain = F.when(comma_is_point, F.regexp_replace(number, ",", ".")).when(suffix != "", number).otherwise(F.regexp_replace(number, ",", ""))
    plain = F.when(plain.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), plain)
    times = F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "b", 1e9).otherwise(1.0)
    return F.coalesce((plain.try_cast("double") * times).cast("long"), F.lit(0).cast("long"))


def rating_from_text(text: Column) -> Column:
    """A number of 0 to 5 that stands alone, perhaps over 5; 0 without one."""
    return _or_zero(F.regexp_extract(text, r"(?<![0-9])([0-5](?:\.[0-9]+)?)\s*(?:/\s*5)?(?![0-9])", 1))


def rating_from_phrase(text: Column) -> Column:
    """The same, for phrases such as ``4.8 out of five stars``; a digit may follow."""
    return _or_zero(F.regexp_extract(text, r"(?<![0-9])([0-5](?:\.[0-9]+)?)", 1))


def rating_from_card(text: Column) -> Column:
    """The last line that is nothing but a rating; empty without one."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[0-5](?:\.[0-9])?$"))
    return F.when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise("")


def _or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def star_number(key: Column) -> Column:
    """The star of ``4_star``; 6, that is last, for anything else."""
    return F.coalesce(F.regexp_extract(key, r"^([1-5])_star$", 1).try_cast("int"), F.lit(6))


def money_text(value: Column, raw: Column) -> Column:
    """``₱1,234``, rounded half to even; else the raw text, else a notice."""
    return F.coalesce(F.concat(F.lit("₱"), F.format_number(F.bround(value.try_cast("double"), 0), 0)), F.nullif(raw, F.lit("")), F.lit("Price unavailable"))


def count_value(text: Column, fallback: Column) -> Column:
    """A count with commas, at least 0; the fallback if it isn't one."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(F.regexp_replace(text.cast("string"), ",", "").try_cast("long"), fallback.cast("long"), F.lit(0).cast("long")))


def whole_if_integral(value: Column) -> Column:
    """A rating as text: without a fraction if it has none."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def total_pages(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(rows / F.lit(size)))


def round_half_even(value: Column, digits: int) -> Column:
    """Rounding to even on the exact binary value of a double; a NaN gives null.

    The product with the power of ten is taken as a rounded product and its exact error (Dekker), so that
    a tie in the product is told from a value just beside one.  Exact for up to seven digits.
    """
    power = float(10**digits)

    def rounded(x: Column) -> Column:
        product, wide = x * power, x * float(2**27 + 1)
        high = wide - (wide - x)
        error = (high * power - product) + (x - high) * power
        floor = F.floor(product).cast("double")
        part = product - floor
        up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (floor % 2 != 0))))
        return F.when(~F.isnan(x), (floor + F.when(up, 1.0).otherwise(0.0)) / power)

    # Bound to a name, so that the value's own expression stands in the plan once, however often it is used.
    return F.element_at(F.transform(F.array(value.cast("double")), lambda x: rounded(x)), 1)
