"""Row-wise column expressions: instants, stability physics, binning, small helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Physical constants as the station analysis uses them.
GRAVITY = 9.81
GAS_CONSTANT = 8.314
KELVIN_OFFSET = 273.15
COLUMN_HEIGHT = 8.0            # metres between the 2 m and the 10 m sensor
REFERENCE_PRESSURE = 1000.0    # hPa
POISSON_EXPONENT = 0.286


def number(value: float) -> Column:
    """A DOUBLE literal."""
    return F.lit(float(value))


def square(x: Column) -> Column:
    """B18. Exact square; ``pow`` is not always."""
    return x * x


def hour_instant() -> Column:
    """B3. Zone-free instant of the hour; NULL where the parts name no instant."""
    return F.try_make_timestamp_ntz(
        F.col("year"), F.col("month"), F.col("day"), F.col("hour"), F.lit(0), F.lit(0).cast("decimal(16,6)")
    )


def minute_instant() -> Column:
    """B4. Zone-free instant of the minute."""
    return F.try_make_timestamp_ntz(
        F.col("year"), F.col("month"), F.col("day"), F.col("hour"), F.col("minute"),
        F.lit(0).cast("decimal(16,6)"),
    )


def hour_literal(text: str) -> Column:
    """B6. An instant from ``'2019-8-2 14'``-style text; months, days and hours need no padding."""
    return F.to_timestamp_ntz(F.lit(text), F.lit("yyyy-M-d H"))


def finite(name: str) -> Column:
    """B25. True for an ordinary number: not NULL, not NaN, not infinite."""
    x = F.col(name)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def clean_zero(x: Column) -> Column:
    """Turn -0.0 into 0.0, leaving every other value alone."""
    return x + number(0.0)


def log_share(share: Column) -> Column:
    """B23. Natural logarithm of a normalised density."""
    return F.ln(share)


def inverse_logit(eta: Column) -> Column:
    """B26. Logistic function, written so that ``exp`` never overflows."""
    small = F.exp(-F.abs(eta))
    return F.when(eta >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def month_label(month: Column) -> Column:
    """B25. English month abbreviation of a month number."""
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")


def richardson(temperature: Column, difference: Column, speed: Column) -> Column:
    """B8/B15. Bulk Richardson number; NULL for calm air or a zero temperature."""
    buoyancy = F.try_divide(number(GRAVITY), temperature)
    return F.try_divide(buoyancy * difference * COLUMN_HEIGHT, square(speed))


def hydrostatic_change(pressure: Column, kelvin: Column) -> Column:
    """B10. Pressure change over the sensor column."""
    return -GRAVITY * F.try_divide(pressure, GAS_CONSTANT * kelvin) * COLUMN_HEIGHT


def potential_temperature(temperature: Column, pressure: Column) -> Column:
    """B12/B13. Temperature brought to the reference pressure."""
    ratio = F.try_divide(number(REFERENCE_PRESSURE), pressure)
    return temperature * F.pow(ratio, number(POISSON_EXPONENT))


def interval_index(x: Column, lo: Column, hi: Column, count: int) -> Column:
    """B17. 1-based index of the right-closed interval of ``count`` equal ones on [lo, hi].

    ``lo`` itself belongs to interval 1. An interval ends at ``lo + i * width``
    as that product is rounded, so the first guess is corrected against the
    edges. With ``lo == hi`` everything is in the middle interval.
    """
    width = (hi - lo) / count
    guess = F.least(F.greatest(F.ceil(F.try_divide(x - lo, width)), F.lit(1)), F.lit(count)).cast("int")
    lower = lo + (guess - 1) * width
    upper = lo + guess * width
    fixed = (
        F.when((x <= lower) & (guess > 1), guess - 1)
        .when((x > upper) & (guess < count), guess + 1)
        .otherwise(guess)
    )
    return F.when(x.isNull(), F.lit(None).cast("int")).when(
        hi == lo, F.lit((count + 1) // 2)
    ).otherwise(fixed)
