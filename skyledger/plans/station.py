"""The composite jobs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import (
    hour_instant,
    hydrostatic_change,
    month_label,
    potential_temperature,
    richardson,
    KELVIN_OFFSET,
)
from ..operators.cells import merged_cells, trend_cells
from ..operators.density import boxplot_stats, density_2d, equal_width_bins
from ..operators.joins import at_instants, attach_summary, interval_join
from ..operators.positions import exclude_ranges
from ..operators.quality import complete_cases, complete_groups, non_negative
from ..operators.regression import cell_regression, linear_model, predict, simple_regression, sufficient_statistics
from ..operators.reshape import zero_fill
from ..operators.rollup import STATISTICS, hourly_summary
from ..operators.smooth import spline_smooth
from ..operators.summaries import event_counts, means_by
from ..schema import HIGH_GUST_SD, MINUTE_KEYS, MINUTES_PER_HOUR, THAW_TEMPERATURE


def clean_minutes(
    minutes: DataFrame, ranges: Iterable[tuple[int, int]], order_by: Sequence[str] = tuple(MINUTE_KEYS), lead: int | None = None
) -> DataFrame:
    """Z9. Minutes with a reading of at least zero, less those at the listed positions in the order of their keys."""
    return exclude_ranges(non_negative(minutes), ranges, order_by, lead)


def complete_hours(minutes: DataFrame, expected: int = MINUTES_PER_HOUR, **options) -> DataFrame:
    """Z1. Statistics of the hours whose readings are all there."""
    return complete_groups(hourly_summary(minutes, **options), expected)


def combine(
    hours: DataFrame,
    summary: DataFrame,
    needed: Sequence[str] = ("gust_time", "t_2m"),
    by_site: bool = False,
) -> DataFrame:
    """Z2. Hours joined to their summary, complete in ``needed``, at instants of complete hours.

    An hour that has to be complete at its own site, be it by ``by_site`` or
    because one of the summary's statistics is needed, has found its row of the
    summary in the join: no semi-join has to look for it again. Otherwise the
    summary is read twice, so hand in a stored one.
    """
    joined = attach_summary(hours, summary.drop("date"))
    dated = complete_cases(joined, needed).withColumn("date", hour_instant())
    if by_site or set(needed) & set(STATISTICS):
        return dated.where(F.col("nrow").isNotNull() & F.col("date").isNotNull())
    return at_instants(dated, summary)


def stability(combined: DataFrame) -> DataFrame:
    """Z3. Add the stability quantities (B7-B15), as one projection.

    Temperatures enter in deg C wherever the analysis uses deg C. A zero
    divisor gives NULL.
    """
    t_2m, t_10m, p, speed = (F.col(c) for c in ("t_2m", "t_10m", "p", "wind_spd"))
    difference = t_10m - t_2m
    kelvin = (t_2m + t_10m) / 2 + KELVIN_OFFSET
    change = hydrostatic_change(p, kelvin)
    theta_2m = potential_temperature(t_2m, p)
    theta_10m = potential_temperature(t_10m, change + p)
    return combined.withColumns(
        {
            "t_difference": difference,
            "richardson_bulk": richardson(t_2m, difference, speed),
            "avg_temp_K": kelvin,
            "delta_p": change,
            "p_10m": change + p,
            "pot_temp_2m": theta_2m,
            "pot_temp_10m": theta_10m,
            "delta_theta": theta_10m - theta_2m,
            "richardson_potential": richardson(t_2m, theta_10m - theta_2m, speed),
        }
    )


def monthly_event_counts(
    combined: DataFrame, event: Column, years: tuple[int, int] | None = None
) -> DataFrame:
    """Z4. Events per month and year, with a zero for every month without one.

    The calendar defaults to the years of all rows, not only of the events.
    """
    return zero_fill(event_counts(combined, event, "month", "year"), years=years)


TREND_MEASURES = ["t_2m", "wind_spd", "wind_sd"]


def trend_events(high_sd: float = HIGH_GUST_SD, thaw: float = THAW_TEMPERATURE) -> dict[str, Column]:
    """The events that Z5 counts: hours of high gusts, and of thaw."""
    return {"gust_count": F.col("wind_sd") > high_sd, "thaw_count": F.col("t_2m") > thaw}


def monthly_trends(
    combined: DataFrame,
    high_sd: float = HIGH_GUST_SD,
    thaw: float = THAW_TEMPERATURE,
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """Z5. Per month, the trend over the years of five measures: one row per measure and month.

    Counts of high-gust and thaw hours are regressed on the year with empty
    years as zero; temperature, wind speed and wind_sd as single hours. The
    hours are read once, into sums per month and year; everything after that
    works on at most twelve rows a year.
    """
    cells = trend_cells(combined, TREND_MEASURES, trend_events(high_sd, thaw), ["month", "year"])
    return _trends(cells, years)


def trends_of_cells(cells: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """Z5 from stored cells of any number of batches and sites (``trend_cells`` of the measures and events of Z5)."""
    return _trends(merged_cells(cells, TREND_MEASURES, list(trend_events()), ["month", "year"]), years)


def _trends(cells: DataFrame, years: tuple[int, int] | None) -> DataFrame:
    events = list(trend_events())
    filled = zero_fill(cells, events, years)

    def cell(metric: str, weight: Column, mean: Column, ssd: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), weight.cast("double").alias("_w"),
            mean.cast("double").alias("_mean"), ssd.cast("double").alias("_ssd"),
        )

    stacked = filled.select(
        "month",
        "year",
        F.inline(
            F.array(
                *(cell(e, F.lit(1), F.col(e), F.lit(0)) for e in events),
                *(cell(c, F.col(f"{c}_w"), F.col(f"{c}_mean"), F.col(f"{c}_ssd")) for c in TREND_MEASURES),
            )
        ),
    )
    fits = cell_regression(stacked, "year", ["metric", "month"])
    return fits.withColumns({"n": F.col("n").cast("long"), "df": F.col("df").cast("long")})


def trend_figure(trends: DataFrame, metric: str) -> DataFrame:
    """B22/B25. Slopes of one measure with error bars and month labels."""
    return trends.where(F.col("metric") == metric).select(
        "month", month_label(F.col("month")).alias("label"), "slope", "lo", "hi"
    )


MEAN_MEASURES = ["wind_spd", "p", "wind_sd", "t_2m"]


def month_mean_trends(combined: DataFrame, columns: Sequence[str] = tuple(MEAN_MEASURES)) -> DataFrame:
    """Z6. Means per month and year, and their trend over the years per month and measure."""
    return _mean_trends(means_by(combined, ["month", "year"], columns), columns)


def mean_trends_of_cells(cells: DataFrame, columns: Sequence[str] = tuple(MEAN_MEASURES)) -> DataFrame:
    """Z6 from stored cells of these columns."""
    means = merged_cells(cells, columns, [], ["month", "year"])
    return _mean_trends(means.select("month", "year", *(F.col(f"{c}_mean").alias(f"mean_{c}") for c in columns)), columns)


def _mean_trends(means: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = means.unpivot(["month", "year"], [f"mean_{c}" for c in columns], "metric", "value")
    return simple_regression(long, "year", "value", ["metric", "month"])


def density_figure(df: DataFrame, x: str, y: str, **options) -> DataFrame:
    """Z7. Cells of a density figure."""
    return density_2d(df, x, y, **options)


def smooth_figure(df: DataFrame, x: Column, y: str, **options) -> DataFrame:
    """Z7. A smooth curve of ``y`` with its band, on any single covariate made of the columns (such as t + t^2)."""
    return spline_smooth(df.select(x.cast("double").alias("covariate"), F.col(y)), "covariate", y, **options)


def box_figure(df: DataFrame, x: str, y: str, breaks: int = 20) -> DataFrame:
    """Z7. Boxes of ``y`` over equal-width bins of ``x``."""
    binned = equal_width_bins(df.select(x, y).where(F.col(x).isNotNull()), x, breaks)
    edges = binned.select("bin", "bin_lo", "bin_hi").distinct()
    return boxplot_stats(binned, "bin", y).join(edges, "bin")


def fit_and_check(df: DataFrame, response: str, terms: dict[str, Column], name: str = "predicted") -> DataFrame:
    """Z8. Least-squares fit, and actual beside predicted for every usable row."""
    fit = linear_model(sufficient_statistics(df, response, terms), list(terms))
    checked = predict(df, fit, terms, name)
    return checked.where(F.col(name).isNotNull() & F.col(response).isNotNull())


def high_gust_windows(summary: DataFrame, event: Column, hours: int = 6) -> DataFrame:
    """The window of ``hours`` before to ``hours`` after each chosen hour."""
    reach = F.make_dt_interval(F.lit(0), F.lit(hours))
    return summary.where(event).select(
        "site",
        F.col("date").alias("event_hour"),
        (F.col("date") - reach).alias("window_start"),
        (F.col("date") + reach).alias("window_end"),
    )


def event_windows(minutes: DataFrame, summary: DataFrame, event: Column, hours: int = 6) -> DataFrame:
    """Z10. The minutes around each chosen hour. ``minutes`` need an instant ``ts``.

    Events are hours, so a minute lies in at most ``2 * hours + 1`` windows of
    its site.
    """
    return interval_join(minutes, high_gust_windows(summary, event, hours))
