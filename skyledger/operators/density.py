"""Equal-width bins and the data behind density and box figures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import interval_index, log_share
from .joins import spread_join
from .quality import censor
from .quantiles import grouped_quantiles

Limits = tuple[float, float] | None

# Shape of a kernel density curve.
KDE_POINTS = 512
KDE_CUT = 4.0              # bandwidths the working grid reaches past the data
BANDWIDTH_FACTOR = 0.9
IQR_PER_SD = 1.34


def _with_range(df: DataFrame, column: str, limits: Limits, prefix: str) -> DataFrame:
    """Add ``<prefix>lo`` and ``<prefix>hi``: the given limits, or the column's extremes."""
    if limits is not None:
        return df.withColumns({f"{prefix}lo": F.lit(float(limits[0])), f"{prefix}hi": F.lit(float(limits[1]))})
    seen = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("r")).scalar()
    return df.withColumn(f"{prefix}r", seen).select(
        *df.columns, F.col(f"{prefix}r.lo").alias(f"{prefix}lo"), F.col(f"{prefix}r.hi").alias(f"{prefix}hi")
    )


def equal_width_bins(df: DataFrame, column: str, breaks: int = 20, name: str = "bin") -> DataFrame:
    """B17. Number the right-closed interval each value falls in, with its edges.

    The outer edges are moved out by a thousandth of the range, so both
    extremes lie inside.
    """
    ranged = _with_range(df, column, None, "_")
    lo, hi = F.col("_lo"), F.col("_hi")
    spread = F.when(hi == lo, F.abs(lo)).otherwise(hi - lo) / 1000
    start = F.when(hi == lo, lo - spread).otherwise(lo)
    stop = F.when(hi == lo, hi + spread).otherwise(hi)
    index = F.col(name)
    width = (stop - start) / breaks
    lower = F.when((index == 1) & (hi != lo), lo - spread).otherwise(start + (index - 1) * width)
    upper = (
        F.when((index == breaks) & (hi != lo), hi + spread)
        .when(index == breaks, stop)
        .otherwise(start + index * width)
    )
    return ranged.withColumn(name, interval_index(F.col(column).cast("double"), lo, hi, breaks)).select(
        *df.columns,
        name,
        F.when(index.isNotNull(), lower).alias(f"{name}_lo"),
        F.when(index.isNotNull(), upper).alias(f"{name}_hi"),
    )


def density_2d(
    df: DataFrame,
    x: str,
    y: str,
    bins: tuple[int, int] = (30, 30),
    x_limits: Limits = None,
    y_limits: Limits = None,
) -> DataFrame:
    """E13. Counts in equal cells, their share of all rows, and that share over the largest.

    Rows outside given limits are dropped first. Cells are right-closed; the
    first also holds the lower limit. Empty cells are not listed.
    """
    points = censor(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")),
                    {"x": x_limits, "y": y_limits}).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranged = _with_range(_with_range(points, "x", x_limits, "_x"), "y", y_limits, "_y")
    cells = (
        ranged.select(
            interval_index(F.col("x"), F.col("_xlo"), F.col("_xhi"), bins[0]).alias("x_bin"),
            interval_index(F.col("y"), F.col("_ylo"), F.col("_yhi"), bins[1]).alias("y_bin"),
            "_xlo", "_xhi", "_ylo", "_yhi",
        )
        .groupBy("x_bin", "y_bin", "_xlo", "_xhi", "_ylo", "_yhi")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # from here on there is at most one row per cell
    everything = Window.partitionBy()
    x_width = (F.col("_xhi") - F.col("_xlo")) / bins[0]
    y_width = (F.col("_yhi") - F.col("_ylo")) / bins[1]
    return cells.select(
        "x_bin",
        "y_bin",
        (F.col("_xlo") + (F.col("x_bin") - 1) * x_width).alias("x_lo"),
        (F.col("_xlo") + F.col("x_bin") * x_width).alias("x_hi"),
        (F.col("_ylo") + (F.col("y_bin") - 1) * y_width).alias("y_lo"),
        (F.col("_ylo") + F.col("y_bin") * y_width).alias("y_hi"),
        "n",
        (F.col("n") / F.sum("n").over(everything)).alias("density"),
        (F.col("n") / F.max("n").over(everything)).alias("ndensity"),
    ).withColumn("log_ndensity", log_share(F.col("ndensity")))


def _fences(df: DataFrame, bin_column: str, y: str) -> DataFrame:
    quartiles = grouped_quantiles(df, [bin_column], y, [0.25, 0.5, 0.75])
    q = F.col("quantiles")
    reach = 1.5 * (q[2] - q[0])
    return quartiles.select(
        bin_column, "n", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"),
        (q[0] - reach).alias("fence_lo"), (q[2] + reach).alias("fence_hi"),
    )


def boxplot_stats(df: DataFrame, bin_column: str, y: str) -> DataFrame:
    """E14. Quartiles per bin, and whiskers to the last values within 1.5 IQR of the box. NULL and NaN are no values."""
    fences = _fences(df, bin_column, y)
    near = F.col(y).between(F.col("fence_lo"), F.col("fence_hi"))
    return (
        df.where(F.col(y).isNotNull() & ~F.isnan(y))
        .join(fences, bin_column)
        .groupBy(bin_column, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(near, F.col(y))).alias("whisker_lo"),
            F.max(F.when(near, F.col(y))).alias("whisker_hi"),
            F.count_if(~near).alias("outliers"),
        )
    )


def boxplot_outliers(df: DataFrame, bin_column: str, y: str) -> DataFrame:
    """E14. The rows beyond the whiskers; one without a value (NULL, NaN) is none."""
    fences = _fences(df, bin_column, y).select(bin_column, "fence_lo", "fence_hi")
    beyond = ~F.isnan(y) & ~F.col(y).between(F.col("fence_lo"), F.col("fence_hi"))
    return df.join(fences, bin_column).where(beyond).select(*df.columns)


def kernel_density(
    df: DataFrame, column: str, by: Sequence[str] = (), limits: Limits = None, points: int = KDE_POINTS
) -> DataFrame:
    """E15. Gaussian kernel density curve, one per group.

    Curves run over the limits (rows outside are dropped first) or over the
    range of all rows. Each value's weight is split between the two nearest
    points of a fixed grid; the grid is smoothed with the kernel and read off
    by linear interpolation. So the rows are touched by one aggregation into
    ``points`` cells per group, and the smoothing works on those cells alone.
    """
    keys = list(by)
    values = censor(
        df.where(F.col(column).isNotNull() & ~F.isnan(column)).select(*keys, F.col(column).cast("double").alias("_v")),
        {"_v": limits},
    )
    spread = values.groupBy(*keys).agg(
        F.stddev_samp("_v").alias("_sd"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    # the curves are few, so their table needs no partitions
    every = Window.partitionBy()
    spread = spread.withColumns(
        {
            "_from": F.min("_min").over(every) if limits is None else F.lit(float(limits[0])),
            "_to": F.max("_max").over(every) if limits is None else F.lit(float(limits[1])),
        }
    )
    quartiles = grouped_quantiles(values, keys, "_v", [0.25, 0.75])
    shape = quartiles.join(spread, keys) if keys else quartiles.withColumn(
        "_s", spread.select(F.struct("*")).scalar()
    ).select("n", "quantiles", "_s.*")
    sd, iqr = F.col("_sd"), (F.col("quantiles")[1] - F.col("quantiles")[0]) / IQR_PER_SD
    smaller = F.least(sd, iqr)
    width = F.when(smaller > 0, smaller).when(sd > 0, sd).when(F.col("_min") != 0, F.abs("_min")).otherwise(1.0)
    curve_columns = ["n", "_from", "_to", "bw"]
    shape = shape.select(
        *keys, "n", "_from", "_to",
        (BANDWIDTH_FACTOR * width * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"),
    )
    lower = F.col("_from") - KDE_CUT * F.col("bw")
    step = (F.col("_to") - F.col("_from") + 2 * KDE_CUT * F.col("bw")) / (points - 1)

    if keys:
        placed = spread_join(values, shape, keys)
    else:
        placed = values.withColumn("_s", shape.select(F.struct("*")).scalar()).select(
            "_v", F.lit(1).alias("_w"), "_s.*"
        )
    place = (F.col("_v") - lower) / step
    cells = (
        placed.withColumn("_cell", F.floor(place).cast("int"))
        .groupBy(*keys, *curve_columns, "_cell")
        .agg(F.sum("_w").alias("_rows"), F.sum(F.col("_w") * (place - F.floor(place))).alias("_over"))
    )
    # weight of a grid point: the near shares of its own cell and the far shares of the cell below
    weights = cells.select(
        *keys, *curve_columns,
        F.inline(
            F.array(
                F.struct(F.col("_cell"), (F.col("_rows") - F.col("_over")).alias("_w")),
                F.struct((F.col("_cell") + 1).alias("_cell"), F.col("_over").alias("_w")),
            )
        ),
    )
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    distance = (F.col("_point") - F.col("_cell")) * step / F.col("bw")
    kernel = F.exp(-0.5 * distance * distance) / (F.col("bw") * math.sqrt(2 * math.pi))
    smooth = (
        weights.groupBy(*keys, *curve_columns, "_cell").agg(F.sum("_w").alias("_w"))
        .withColumn("_point", F.explode(grid))
        .groupBy(*keys, *curve_columns, "_point")
        .agg((F.sum(F.col("_w") * kernel) / F.col("n")).alias("_density"))
    )
    # one short array of grid densities per group, read off at the output points
    curve = (
        smooth.groupBy(*keys, *curve_columns)
        .agg(F.sort_array(F.collect_list(F.struct("_point", "_density"))).alias("_curve"))
        .withColumn("_i", F.explode(grid))
    )
    x = F.col("_from") + F.col("_i") * (F.col("_to") - F.col("_from")) / (points - 1)
    at = (x - lower) / step
    left = F.floor(at).cast("int")
    here, there = F.col("_curve")[left]["_density"], F.col("_curve")[left + 1]["_density"]
    return curve.select(
        *keys, F.col("_i").alias("point"), x.alias("x"),
        (here + (at - left) * (there - here)).alias("density"), "bw", "n",
    )
