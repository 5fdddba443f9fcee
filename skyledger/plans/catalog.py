"""The registered queries: every operator over the station-shaped views of the supplied tables.

The views hold four readings per complete hour and calmer gusts than a real
station, so the completeness rule asks for 4 rows and high gusts start at 4.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalars import clean_zero, hour_instant, minute_instant
from ..operators import bayes
from ..operators.cells import add_cells, read_cells, trend_cells
from ..operators.density import boxplot_outliers, boxplot_stats, density_2d, equal_width_bins, kernel_density
from ..operators.joins import attach_summary, left_join_suffixed, outside_intervals
from ..operators.orthogonal import qr_factor, qr_model
from ..operators.positions import exclude_ranges, with_row_numbers
from ..operators.predictive import predictive_boxes, predictive_density
from ..operators.quality import (
    above,
    complete_cases,
    date_slice,
    finite_rows,
    hour_slice,
    month_view,
    non_negative,
    null_negative,
    null_sentinels,
    open_band,
    plausible,
    without_day,
)
from ..operators.regression import (
    confidence_band,
    factorial_terms,
    linear_model,
    plain_terms,
    simple_regression,
    statistics_long,
    sufficient_statistics,
    with_p_values,
)
from ..operators.reshape import sample_rows, stack, to_long
from ..operators.rollup import hourly_summary
from ..operators.smooth import spline_smooth
from ..operators.summaries import column_intervals, correlation, count_by, means_by, overall_mean
from ..operators.zero_inflated import zero_inflated_fit, zero_inflated_mean
from ..schema import HOUR_KEYS, HOUR_SCHEMA, HOUR_SENTINELS, MINUTE_KEYS, MINUTE_SCHEMA, MINUTE_SENTINELS, THAW_TEMPERATURE
from ..session import new_shared_path, stored
from ..sources import sample_views as views
from ..sources.bucketed import join_stored, store_bucketed
from ..sources.tables import grid_values, read_table, write_table
from ..sources.text import hour_lines, minute_lines
from .published import published_trends
from .station import (
    MEAN_MEASURES,
    TREND_MEASURES,
    box_figure,
    clean_minutes,
    combine,
    complete_hours,
    density_figure,
    event_windows,
    fit_and_check,
    mean_trends_of_cells,
    month_mean_trends,
    monthly_event_counts,
    monthly_trends,
    smooth_figure,
    stability,
    trend_events,
    trend_figure,
    trends_of_cells,
)

Query = Callable[[SparkSession, str], DataFrame]

HIGH_SD = 4.0
EVENT_SD = 8.0
BUCKETS = 8
MEAN_DIGITS = 9    # readings have one decimal, so a mean can end on the digit after the sixth
SPAN = (views.FIRST_YEAR, views.LAST_YEAR)
# positions and stretches of time that count as artefacts in the observation view
BAD_POSITIONS = [(1, 1), (3, 3), (17, 250), (251, 260), (700, 705), (4000, 9000), (99_000, 10**12)]
BAD_TIMES = [
    ("click", "2024-01-03 05:00:00", "2024-01-03 07:30:00"),
    ("view", "2024-01-10 22:00:00", "2024-01-12 03:00:00"),
    ("error", "2024-01-20 00:00:00", "2024-01-20 00:00:00"),
]

TWO_TERM_MODELS = [name for name, model in bayes.MODELS.items() if len(model.terms) == 2]

_QUERIES: dict[str, Query] = {}


def _query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        _QUERIES[name] = build
        return build

    return register


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, so that different summing orders compare equal."""
    return df.select(
        *(
            clean_zero(F.round(f.name, digits)).alias(f.name) if isinstance(f.dataType, DoubleType) else f.name
            for f in df.schema
        )
    )


def _summary(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return complete_hours(views.minutes(spark, sf_dir), views.COMPLETE_ROWS, **options)


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine(views.hours(spark, sf_dir), _summary(spark, sf_dir))


def _combined_gusts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``_combined``, of the statistics only ``gust_time``."""
    return combine(views.hours(spark, sf_dir), _summary(spark, sf_dir, statistics=("gust_time",)))


def _stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability(_combined(spark, sf_dir))


def _plotted(hours: DataFrame) -> DataFrame:
    """wind_sd to six places, so that a value on a cell's edge is on it in every engine."""
    return hours.withColumn("wind_sd", F.round("wind_sd", 6))


def _hourly_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {p: F.date_part(F.lit(p), "ts").cast("int") for p in ("year", "month", "day", "hour", "minute")}
    return views.observations(spark, sf_dir).withColumns(parts)


# --- sources and cleaning ---------------------------------------------------


@_query("scan_clean_minutes")
def scan_clean_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B2."""
    return null_negative(null_sentinels(views.minutes(spark, sf_dir), MINUTE_SENTINELS))


@_query("scan_clean_hours")
def scan_clean_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B2."""
    return null_negative(null_sentinels(views.hours(spark, sf_dir), HOUR_SENTINELS))


@_query("text_minutes")
def text_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the minute table as blank-separated lines, parsed and cleaned."""
    cells = (F.col(c).cast("string") for c in MINUTE_SCHEMA.names)
    return minute_lines(views.minutes(spark, sf_dir).select(F.concat(F.lit("  "), F.concat_ws("   ", *cells)).alias("value")))


@_query("text_hours")
def text_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the hour table likewise."""
    cells = (F.col(c).cast("string") for c in HOUR_SCHEMA.names)
    return hour_lines(views.hours(spark, sf_dir).select(F.concat_ws(" ", *cells).alias("value")))


@_query("stored_hours")
def stored_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined table stored by year and read back for some years."""
    path = new_shared_path(spark, "combined")
    write_table(_combined(spark, sf_dir), path)
    recent = read_table(spark, path).where(F.col("year") >= 2015)
    return rounded(recent.select(*HOUR_KEYS, "date", "t_2m", "wind_spd", "wind_sd", "gust_time"))


@_query("hour_timestamps")
def hour_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3, B5."""
    dated = views.hours(spark, sf_dir).select(*HOUR_KEYS, hour_instant().alias("date"))
    return dated.withColumn("calendar_day", F.to_date("date"))


@_query("minute_timestamps")
def minute_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4, B5."""
    dated = _hourly_observations(spark, sf_dir).select("event_id", minute_instant().alias("date"))
    return dated.withColumn("calendar_day", F.to_date("date"))


# --- roll-up and joins ------------------------------------------------------


@_query("hourly_summary")
def hourly_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour, statistics missing where a reading is."""
    return rounded(hourly_summary(views.minutes(spark, sf_dir)))


@_query("hourly_summary_skipna")
def hourly_summary_skipna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 with missing readings skipped."""
    return rounded(hourly_summary(views.minutes(spark, sf_dir), na="skip"))


@_query("hourly_summary_refined")
def hourly_summary_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2b."""
    return rounded(hourly_summary(views.minutes(spark, sf_dir), gust="refined"))


@_query("complete_hours")
def complete_hours_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z1, C2."""
    return rounded(_summary(spark, sf_dir))


@_query("combined")
def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hours, with the statistics of the complete ones."""
    return rounded(attach_summary(views.hours(spark, sf_dir), _summary(spark, sf_dir)))


@_query("combined_complete")
def combined_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, C1, B3; a needed statistic settles D3."""
    return rounded(_combined(spark, sf_dir))


@_query("combined_refined")
def combined_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z2 with refined gusts, complete in temperature and speed, matched by site and instant."""
    summary = _summary(spark, sf_dir, gust="refined")
    return rounded(combine(views.hours(spark, sf_dir), summary, ("t_2m", "wind_spd"), by_site=True))


@_query("combined_any_site")
def combined_any_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with temperature and speed at the instants of hours that are complete at any site."""
    summary = stored(_summary(spark, sf_dir), "summary")    # for the join and for the instants
    return rounded(combine(views.hours(spark, sf_dir), summary, ("t_2m", "wind_spd")))


@_query("left_join_suffixed")
def left_join_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary attached a second time, its clashing columns kept apart."""
    again = _summary(spark, sf_dir).select(
        "site", "date", F.col("gust_time").alias("new_gust_time"),
        "wind_mean", "wind_sd", "wind_max", "wind_min", "wind_med",
    )
    base = _combined(spark, sf_dir).select(
        "site", "date", "t_2m", "gust_time", "wind_mean", "wind_sd", "wind_max", "wind_min", "wind_med"
    )
    return rounded(left_join_suffixed(base, again, ["site", "date"]))


def _stored_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hours and complete hours in buckets; one year of the summary arrives a second time and takes the first one's place."""
    hours = store_bucketed(views.hours(spark, sf_dir), new_shared_path(spark, "hours"), BUCKETS)
    summary = _summary(spark, sf_dir)
    kept = store_bucketed(summary.withColumn("nrow", F.when(F.col("year") == views.LAST_YEAR, 0).otherwise(F.col("nrow"))), new_shared_path(spark, "summary"), BUCKETS)
    kept.replace_years(_summary_of_year(spark, sf_dir, views.LAST_YEAR))
    return hours.read(spark), kept.read(spark)


def _summary_of_year(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    return complete_hours(views.minutes(spark, sf_dir).where(F.col("year") == year), views.COMPLETE_ROWS)


@_query("stored_join")
def stored_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour table joined to its summary bucket by bucket."""
    hours, summary = _stored_pair(spark, sf_dir)
    return rounded(join_stored(hours, summary).select(*HOUR_KEYS, "t_2m", "wind_spd", "wind_sd", "gust_time", "nrow"))


@_query("stored_join_suffixed")
def stored_join_suffixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 likewise: the summary beside itself, shifted, with suffixes."""
    summary = _stored_pair(spark, sf_dir)[1].select(*HOUR_KEYS, "wind_mean", "wind_max")
    return rounded(join_stored(summary, summary.where("wind_max > 5")))


@_query("stability")
def stability_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3: B7-B15."""
    return rounded(
        stability(_combined_gusts(spark, sf_dir)).select(
            "site", "date", "t_difference", "richardson_bulk", "avg_temp_K", "delta_p", "p_10m",
            "pot_temp_2m", "pot_temp_10m", "delta_theta", "richardson_potential",
        )
    )


# --- filters ----------------------------------------------------------------


@_query("finite_complete_cases")
def finite_complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11, C12 on a frame that does hold infinities, NaN and NULL."""
    hours = null_sentinels(views.hours(spark, sf_dir), HOUR_SENTINELS)
    ratio = F.when(F.col("wind_spd") == 0, F.lit(float("inf"))).otherwise(F.col("t_2m") / F.col("wind_spd"))
    inverse = F.when(F.col("t_2m") == 0, F.lit(float("nan"))).otherwise(9.81 / F.col("t_2m"))
    frame = hours.select(*HOUR_KEYS, "wind_dir", "rh", ratio.alias("ratio"), inverse.alias("inverse"))
    return rounded(complete_cases(finite_rows(frame, ["ratio", "inverse"])))


@_query("plausibility_caps")
def plausibility_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8, C7."""
    kept = plausible(_combined(spark, sf_dir), max_sd=5.0, max_wind=11.0)
    return rounded(above(kept, "wind_min", 1.0).select("site", "date", "wind_sd", "wind_max", "wind_min"))


@_query("drop_negative_raw")
def drop_negative_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9."""
    kept = non_negative(views.minutes(spark, sf_dir))
    return kept.select(*HOUR_KEYS, "minute", "wind_spd")


@_query("row_numbers")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B24."""
    numbered = with_row_numbers(views.observations(spark, sf_dir), ["event_id"])
    return numbered.select("event_id", "row")


@_query("minute_positions")
def minute_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B24 in the order of site and time; the view repeats some minutes."""
    return with_row_numbers(views.minutes(spark, sf_dir).select(*MINUTE_KEYS, "wind_spd"), [*MINUTE_KEYS, "wind_spd"])


@_query("exclude_ranges")
def exclude_row_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10, D4."""
    kept = exclude_ranges(views.observations(spark, sf_dir), BAD_POSITIONS, ["event_id"])
    return rounded(kept.select("event_id", "site", "wind_spd"))


@_query("combined_exclusions")
def combined_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10, D4 on the stored combined hours, counted by site and hour."""
    kept = exclude_ranges(stored(_combined(spark, sf_dir), "combined"), BAD_POSITIONS, [*HOUR_KEYS, "t_2m", "wind_sd"], 4)
    return rounded(kept.select(*HOUR_KEYS, "t_2m", "wind_sd"))


@_query("exclude_time_ranges")
def exclude_time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 by time."""
    bad = spark.createDataFrame(BAD_TIMES, "site string, from_ts string, to_ts string")
    bad = bad.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("from_ts", "to_ts")})
    return rounded(outside_intervals(views.observations(spark, sf_dir), bad).select("event_id", "site", "wind_spd"))


@_query("clean_minute_rows")
def clean_minute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9, then C10 counted over the rows that are left."""
    readings = views.observations(spark, sf_dir).withColumn("wind_spd", F.col("wind_spd") - 0.5)
    kept = clean_minutes(readings, BAD_POSITIONS, ["event_id"])
    return rounded(kept.select("event_id", "wind_spd"))


@_query("clean_station_minutes")
def clean_station_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z9 on the minute table: positions by site and minute, counted by hour."""
    order = [*MINUTE_KEYS, "wind_spd", "t_2m"]
    kept = clean_minutes(views.minutes(spark, sf_dir), BAD_POSITIONS, order, len(HOUR_KEYS))
    return kept.select(*order)


@_query("high_gusts")
def high_gusts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3."""
    return rounded(open_band(_combined(spark, sf_dir)).select("site", "date", "month", "t_2m", "wind_sd"))


@_query("high_gust_mean_temp")
def high_gust_mean_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3, E7."""
    return rounded(overall_mean(open_band(_combined(spark, sf_dir)), "t_2m"))


@_query("month_view")
def august_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4."""
    return rounded(month_view(_combined(spark, sf_dir), 8).select("site", "date", "year", "t_2m", "wind_sd"))


@_query("time_slice")
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13, B6."""
    days = date_slice(views.observations(spark, sf_dir), date(2024, 1, 10), date(2024, 1, 12), "ts")
    return rounded(days.select("event_id", "ts", "wind_spd"))


@_query("hour_slice_band")
def hour_slice_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14, C15, B6."""
    hours = hour_slice(
        views.observations(spark, sf_dir), "2024-1-11 0", "2024-1-11 23", value="wind_spd", band=(2.0, 9.0)
    )
    return rounded(hours.select("event_id", "ts", "wind_spd"))


@_query("event_windows")
def around_high_gusts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations within six hours of each gusty hour of their site."""
    readings = _hourly_observations(spark, sf_dir)
    windows = event_windows(readings, hourly_summary(readings), F.col("wind_sd") > EVENT_SD)
    return rounded(windows.select("site", "event_hour", "event_id", "ts", "wind_spd"))


# --- counts, means, trends --------------------------------------------------


@_query("gust_counts")
def gust_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5, E4."""
    return count_by(above(_combined(spark, sf_dir), "wind_sd", HIGH_SD), "month", "year")


@_query("gust_counts_zero_filled")
def gust_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5, E4, G3."""
    return monthly_event_counts(_combined(spark, sf_dir), F.col("wind_sd") > HIGH_SD, SPAN)


@_query("thaw_counts_zero_filled")
def thaw_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6, E4, G3, with the years taken from the data."""
    return monthly_event_counts(_combined(spark, sf_dir), F.col("t_2m") > THAW_TEMPERATURE)


@_query("counts_excluding_day")
def counts_excluding_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16."""
    kept = without_day(_combined(spark, sf_dir), month=8, day=1)
    return monthly_event_counts(kept, F.col("wind_sd") > HIGH_SD, SPAN)


@_query("annual_means")
def annual_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5."""
    return rounded(means_by(_combined(spark, sf_dir), ["year"], ["wind_spd"]), MEAN_DIGITS)


@_query("month_year_means")
def month_year_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6."""
    means = means_by(_combined(spark, sf_dir), ["month", "year"], ["wind_spd", "p", "wind_sd", "t_2m"])
    return rounded(means, MEAN_DIGITS)


@_query("correlation")
def pressure_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8."""
    return rounded(correlation(_combined(spark, sf_dir), "wind_sd", "p"))


@_query("monthly_trends")
def monthly_trend_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9, B22."""
    trends = monthly_trends(_combined(spark, sf_dir), HIGH_SD, years=SPAN)
    return rounded(
        trends.select("metric", "month", "n", "slope", "intercept", "std_error", "t_value", "r2", "adj_r2", "lo", "hi")
    )


def _added_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two batches, the days to the 14th and the rest, stored one after the other."""
    path = new_shared_path(spark, "cells")
    hours = _combined(spark, sf_dir)
    measures = sorted({*TREND_MEASURES, *MEAN_MEASURES})
    for batch, rows in (("early", hours.where("day <= 14")), ("late", hours.where("day > 14"))):
        add_cells(trend_cells(rows, measures, trend_events(HIGH_SD)), path, batch)
    return read_cells(spark, path)


@_query("trends_of_stored_cells")
def trends_of_stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trends again, from cells that were stored in two batches."""
    trends = trends_of_cells(_added_cells(spark, sf_dir), SPAN)
    return rounded(trends.select("metric", "month", "n", "slope", "intercept", "std_error", "t_value", "r2", "adj_r2", "lo", "hi"))


@_query("mean_trends_of_stored_cells")
def mean_trends_of_stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likewise the trends of monthly means."""
    trends = mean_trends_of_cells(_added_cells(spark, sf_dir))
    return rounded(trends.select("metric", "month", "n", "slope", "std_error", "r2"))


@_query("trend_significance")
def trend_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values of the trends."""
    trends = with_p_values(monthly_trends(_combined(spark, sf_dir), HIGH_SD, years=SPAN))
    return rounded(trends.select("metric", "month", "df", "t_value", "p_value"))


@_query("gust_trend_figure")
def gust_trend_figure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes with error bars and month labels."""
    return rounded(trend_figure(monthly_trends(_combined(spark, sf_dir), HIGH_SD, years=SPAN), "gust_count"))


@_query("literal_trend_table")
def published_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the trend table beside the published one."""
    trends = monthly_trends(_combined(spark, sf_dir), HIGH_SD, years=SPAN)
    both = trends.join(published_trends(spark), ["metric", "month"])
    return rounded(
        both.select(
            "metric", "month", "published_slope", "published_error",
            (F.col("slope") - F.col("published_slope")).alias("slope_gap"),
        )
    )


@_query("month_mean_trends")
def month_mean_trend_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6, E9."""
    return rounded(
        month_mean_trends(_combined(spark, sf_dir)).select("metric", "month", "n", "slope", "std_error", "r2")
    )


@_query("high_gust_trend")
def high_gust_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9 on the high-gust hours themselves."""
    high = above(_combined(spark, sf_dir), "wind_sd", HIGH_SD)
    fits = simple_regression(high, "year", "wind_sd", ["month"])
    return rounded(fits.select("month", "n", "slope", "intercept", "std_error", "intercept_error", "sigma", "r2"))


@_query("trend_band")
def trend_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of wind_sd over the years with 95 % bands."""
    fits = simple_regression(_combined(spark, sf_dir), "year", "wind_sd", ["month"])
    first, last = (F.lit(float(y)) for y in SPAN)
    return rounded(
        confidence_band(fits, first, last, views.YEARS).select("month", "x", "fit", "se_fit", "lower", "upper")
    )


# --- regression -------------------------------------------------------------


@_query("sufficient_statistics")
def wind_sd_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12."""
    names = ["wind_spd", "t_2m"]
    sums = sufficient_statistics(_combined(spark, sf_dir), "wind_sd", plain_terms(*names))
    return rounded(statistics_long(sums, "wind_sd", names))


@_query("multiple_regression")
def multiple_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10."""
    names = ["wind_spd", "t_2m"]
    sums = sufficient_statistics(_combined(spark, sf_dir), "wind_sd", plain_terms(*names))
    fit = linear_model(sums, names)
    return rounded(fit.select("term", "n", "df", "estimate", "std_error", "t_value", "p_value", "r2", "sigma"))


@_query("predicted_vs_actual")
def predicted_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z8, E10."""
    checked = fit_and_check(_combined(spark, sf_dir), "wind_sd", plain_terms("wind_spd", "t_2m"))
    return rounded(checked.select("site", "date", F.col("wind_sd").alias("actual"), "predicted"))


@_query("prediction_correlation")
def prediction_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z8, E8."""
    checked = fit_and_check(_combined(spark, sf_dir), "wind_sd", plain_terms("wind_spd", "t_2m"))
    return rounded(correlation(checked, "predicted", "wind_sd"))


@_query("factorial_regression")
def factorial_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All interactions of speed, temperature and Richardson number."""
    terms = factorial_terms("wind_spd", "t_2m", "richardson_bulk")
    fit = qr_model(qr_factor(_stable(spark, sf_dir), "wind_sd", terms), list(terms))
    return rounded(fit.select("term", "n", "df", "estimate", "std_error", "t_value", "r2"))


# --- figures ----------------------------------------------------------------


@_query("equal_width_bins")
def speed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B17."""
    binned = equal_width_bins(_combined(spark, sf_dir).select("site", "date", "wind_spd"), "wind_spd", 20)
    return rounded(binned)


@_query("boxplot_stats")
def boxplot_by_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B17, E14, Z7."""
    return rounded(box_figure(_stable(spark, sf_dir), "t_2m", "wind_sd"))


@_query("boxplot_by_month")
def boxplot_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E14 with the month as the bin."""
    return rounded(boxplot_stats(_stable(spark, sf_dir), "month", "wind_max"))


@_query("boxplot_with_gaps")
def boxplot_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E14 on values that are NaN in places."""
    inverse = F.when(F.col("t_2m") == 0, F.lit(float("nan"))).otherwise(100 / F.col("t_2m"))
    return rounded(boxplot_stats(views.hours(spark, sf_dir).select("month", inverse.alias("inverse")), "month", "inverse"))


@_query("boxplot_outliers")
def boxplot_outlier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points beyond the whiskers."""
    readings = views.observations(spark, sf_dir).withColumn("hour", F.hour("ts"))
    return rounded(boxplot_outliers(readings, "hour", "wind_spd").select("event_id", "hour", "wind_spd"))


@_query("density_2d")
def density_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13, B23, C15 with given limits."""
    return rounded(
        density_figure(
            _plotted(_combined(spark, sf_dir)), "wind_spd", "wind_sd", bins=(30, 30), x_limits=(0.0, 25.0), y_limits=(0.0, 5.0)
        )
    )


@_query("density_cells_free")
def density_cells_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13, B23 over the whole range of the data."""
    return rounded(density_2d(_plotted(_stable(spark, sf_dir)), "t_difference", "wind_sd", (100, 100)))


@_query("kde")
def kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E15, C15."""
    return rounded(kernel_density(views.observations(spark, sf_dir), "wind_spd", limits=(0.0, 20.0)))


@_query("kde_by_group")
def kde_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E15 per site."""
    return rounded(kernel_density(views.observations(spark, sf_dir), "wind_spd", ["site"]))


@_query("scatter_data")
def scatter_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B27."""
    return rounded(_combined(spark, sf_dir).where(F.col("wind_sd") <= 5).select("date", "p", "wind_sd"))


@_query("sample_rows")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1."""
    return rounded(sample_rows(views.observations(spark, sf_dir), 200, ["event_id"]).select("event_id", "wind_spd"))


@_query("minute_stats_long")
def minute_stats_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    hours = _combined(spark, sf_dir)
    return rounded(to_long(hours, ["site", "date", "wind_spd"], ["wind_max", "wind_min", "wind_sd", "gust_time"]))


@_query("gust_indicator")
def gust_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B16."""
    return _combined(spark, sf_dir).select("site", "date", (F.col("gust_time") > 0).alias("has_gusts"))


@_query("model_frame")
def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B18, B20, B25."""
    frame = _stable(spark, sf_dir).select(
        "wind_sd", "t_2m", "wind_spd", F.col("richardson_bulk").alias("bulk_richardson"),
        (F.col("t_2m") * F.col("t_2m")).alias("t_2m_squared"),
    )
    return rounded(complete_cases(finite_rows(complete_cases(frame, ["wind_spd"]))))


@_query("prediction_grid")
def prediction_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: thirty even steps over the temperatures seen."""
    seen = _combined(spark, sf_dir).agg(F.min("t_2m").alias("lo"), F.max("t_2m").alias("hi"))
    return rounded(seen.select(F.posexplode(grid_values(F.col("lo"), F.col("hi"), 30)).alias("point", "t_2m")))


@_query("draw_intervals")
def draw_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E16, with an hour's readings standing in for a row's draws."""
    minutes = null_negative(views.minutes(spark, sf_dir))
    return rounded(column_intervals(minutes.where(F.col("wind_spd").isNotNull()), HOUR_KEYS, "wind_spd"))


@_query("smooth_curve")
def smooth_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L7."""
    return rounded(spline_smooth(_stable(spark, sf_dir), "t_2m", "wind_sd"))


@_query("smooth_by_variable")
def smooth_by_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One curve per minute statistic, within limits."""
    columns = ["wind_max", "wind_min", "wind_sd", "gust_time"]
    long = to_long(_stable(spark, sf_dir), ["wind_spd"], columns)
    return rounded(spline_smooth(long, "wind_spd", "value", by=["var"], limits={"wind_spd": (0.0, 19.0)}))


@_query("smooth_figure")
def smooth_of_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve on t + t^2 as one covariate, within limits."""
    temperature = F.col("t_2m")
    return rounded(smooth_figure(_stable(spark, sf_dir), temperature + temperature * temperature, "wind_sd", limits={"covariate": (0.0, 1600.0)}))


# --- Bayesian models --------------------------------------------------------


def _fitted(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, bayes.GaussianModel]:
    model = bayes.MODELS[name]
    return bayes.model_statistics(_stable(spark, sf_dir), model), model


@_query("posterior_map")
def posterior_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode and intervals of the two-predictor model."""
    sums, model = _fitted(spark, sf_dir, "sd_multi")
    return rounded(bayes.mode_summary(bayes.posterior_mode(sums, model)))


@_query("posterior_map_quadratic")
def posterior_map_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: the quadratic model in temperature."""
    sums, model = _fitted(spark, sf_dir, "sd_t")
    return rounded(bayes.mode_summary(bayes.posterior_mode(sums, model)))


@_query("posterior_map_models")
def posterior_map_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes of every two-term model of the analysis."""
    hours = _stable(spark, sf_dir)
    fits = []
    for name in TWO_TERM_MODELS:
        model = bayes.MODELS[name]
        mode = bayes.posterior_mode(bayes.model_statistics(hours, model), model)
        fits.append(mode.select("parameter", "mean", "sd", F.lit(name).alias("model")))
    return rounded(stack(*fits))


@_query("posterior_map_richardson")
def posterior_map_richardson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-predictor model."""
    sums, model = _fitted(spark, sf_dir, "sd_multi_ri")
    return rounded(bayes.mode_summary(bayes.posterior_mode(sums, model)))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _stable(spark, sf_dir)
    model = bayes.MODELS["sd_w"]
    mode = bayes.posterior_mode(bayes.model_statistics(hours, model), model)
    return bayes.predictive_moments(hours.select("wind_spd"), mode, model)


@_query("predictive_density")
def predicted_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density of predicted wind_sd over wind speed, without draws."""
    return rounded(predictive_density(_predicted(spark, sf_dir), "wind_spd", "mean", "sd", (20, 25), (0.0, 20.0), (-2.0, 8.0)))


@_query("predictive_boxes")
def predicted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the predictions."""
    return rounded(predictive_boxes(_predicted(spark, sf_dir), "wind_spd", "mean", "sd", 10, (0.0, 20.0), (-4.0, 12.0), 128))


#: Temperatures lie below zero on average, so the floor of the formula models binds.
FLOOR_MODEL = bayes.GaussianModel("t_2m", ("wind_spd", "wind_spd^2"), (5.0, 5.0), ((0.0, 1.0), None), 0.05, True, 0.0)


@_query("posterior_map_bounded")
def posterior_map_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: a formula model whose mode lies on the floor."""
    hours = _combined(spark, sf_dir)
    return rounded(bayes.bounded_mode(bayes.model_statistics(hours, FLOOR_MODEL), FLOOR_MODEL))


@_query("posterior_marginals")
def posterior_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and intervals of the marginals, by quadrature over sigma."""
    sums, model = _fitted(spark, sf_dir, "sd_t")
    return rounded(bayes.marginal_summary(sums, model))


@_query("posterior_mean_band_exact")
def posterior_mean_band_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of the mean along a grid of temperatures, by quadrature over sigma."""
    hours = _stable(spark, sf_dir)
    model = bayes.MODELS["sd_t"]
    seen = hours.agg(F.min("t_2m").alias("lo"), F.max("t_2m").alias("hi"))
    grid = seen.select(F.posexplode(grid_values(F.col("lo"), F.col("hi"), 30)).alias("point", "t_2m"))
    return rounded(bayes.mixture_band(grid, bayes.model_statistics(hours, model), model))


@_query("posterior_mean_band")
def posterior_mean_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean and its interval along a grid of temperatures."""
    hours = _stable(spark, sf_dir)
    model = bayes.MODELS["sd_t"]
    mode = bayes.posterior_mode(bayes.model_statistics(hours, model), model)
    seen = hours.agg(F.min("t_2m").alias("lo"), F.max("t_2m").alias("hi"))
    grid = seen.select(F.posexplode(grid_values(F.col("lo"), F.col("hi"), 30)).alias("point", "t_2m"))
    return rounded(bayes.normal_band(grid, mode, model))


@_query("predictive_band")
def predictive_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of responses at every hour."""
    hours = _stable(spark, sf_dir)
    model = bayes.MODELS["sd_w"]
    mode = bayes.posterior_mode(bayes.model_statistics(hours, model), model)
    rows = hours.select("site", "date", "wind_spd", "wind_sd")
    return rounded(bayes.normal_band(rows, mode, model, predictive=True))


@_query("zero_inflated_fit")
def zero_inflated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit, read off along the temperatures seen."""
    hours = _stable(spark, sf_dir)
    fit = zero_inflated_fit(hours, trials=views.COMPLETE_ROWS)
    seen = hours.agg(F.min("t_2m").alias("lo"), F.max("t_2m").alias("hi"))
    grid = seen.select(F.explode(grid_values(F.col("lo"), F.col("hi"), 30)).alias("t_2m"))
    return rounded(zero_inflated_mean(grid, fit, trials=views.COMPLETE_ROWS))


@_query("zero_inflated_parameters")
def zero_inflated_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode and spread of the zero-inflated model."""
    fit = zero_inflated_fit(_stable(spark, sf_dir), trials=views.COMPLETE_ROWS)
    return rounded(fit.select("n", "p_zero", "a", "b1", "b2", "p_zero_sd", "a_sd", "b1_sd", "b2_sd"))
