"""Published trends of the station, as a literal table (A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import literal_table

# Published slopes per year and their standard errors, months 1 to 12.
PUBLISHED_TRENDS = {
    "gust_slope": [0.05468, 0.00936, 0.2429, 0.04286, 0.01429, 0.02167, 0.09332, 0.3035, 0.1924, 0.1253, 0.25972, 0.14067],
    "gust_slope_error": [0.05445, 0.02459, 0.1464, 0.03356, 0.03123, 0.01801, 0.03749, 0.1454, 0.1212, 0.1047, 0.09101, 0.04984],
    "temp_slope": [0.14972, 0.07747, 0.1603, 0.05521, 0.09262, 0.023258, 0.05198, 0.01883, 0.06779, 0.2429, 0.1890, 0.1285],
    "temp_slope_error": [0.00615, 0.007286, 0.006139, 0.00576, 0.003992, 0.002591, 0.00307, 0.00299, 0.002683, 0.002429, 0.00189, 0.005753],
    "wind_spd_slope": [0.023519, 0.007336, 0.016447, 0.021963, 0.001949, 0.028198, -0.005238, -0.0002307, -0.004906, 0.011290, 0.028367, 0.041099],
    "wind_spd_slope_error": [0.003036, 0.007336, 0.00294, 0.002473, 0.002174, 0.001928, 0.002148, 0.0023891, 0.002493, 0.002944, 0.003128, 0.003136],
    "mean_st_dev_slope": [0.007056, 0.005667, 0.007224, 0.0042022, 0.005018, 0.006747, 0.006214, 0.008362, 0.005922, 0.007642, 0.009847, 0.009264],
    "mean_st_dev_slope_error": [0.0002719, 0.0002755, 0.000261, 0.0002068, 0.000198, 0.0001863, 0.0002128, 0.000248, 0.0002607, 0.0003094, 0.0003064, 0.0002893],
    "thawcount_slope": [0.1297, 0.09524, 0.07115, -0.1702, 3.415, -0.6286, -4.045, 1.719, 6.397, 9.056, 1.2556, 0.05720],
    "thawcount_slope_error": [0.1068, 0.05757, 0.06436, 0.4414, 2.523, 1.8171, 3.308, 1.625, 2.603, 2.476, 0.4816, 0.06336],
}

# Which published column belongs to which computed measure.
MEASURES = {
    "gust_count": "gust",
    "t_2m": "temp",
    "wind_spd": "wind_spd",
    "wind_sd": "mean_st_dev",
    "thaw_count": "thawcount",
}


def published_trends(spark: SparkSession) -> DataFrame:
    """One row per measure and month: the published slope and its error."""
    months = range(1, 13)
    columns = {"metric": [], "month": [], "published_slope": [], "published_error": []}
    for metric, name in MEASURES.items():
        columns["metric"] += [metric] * 12
        columns["month"] += months
        columns["published_slope"] += PUBLISHED_TRENDS[f"{name}_slope"]
        columns["published_error"] += PUBLISHED_TRENDS[f"{name}_slope_error"]
    return literal_table(
        spark, columns, "metric string, month int, published_slope double, published_error double"
    )
