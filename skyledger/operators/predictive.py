"""Densities and boxes of predictions without draws (Z8 with E13, E14).

Each row's prediction is a normal distribution; a group's predictions are their
mixture. How many of a group's responses are expected below each edge of a grid
is a sum over its rows, so one scan gives it: every task adds up its rows'
distribution functions at the edges and hands on one number per group and edge.
Cells of a density are differences of these, quantiles are read off between edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.normal import distribution
from ..functions.scalars import interval_index, log_share

_ROWS = 4096    # rows whose distribution functions are in an array at a time
EDGES = 256


def expected_below(df: DataFrame, x: str, mean: str, sd: str, bins: int, x_limits: tuple[float, float], edges: np.ndarray) -> DataFrame:
    """x_bin, edge (its number from 0), below: expected responses up to the edge among the rows of each bin.

    Bins are right-closed, the first also holds the lower limit; rows outside
    the limits, or without a mean or sd, are left out. A sd of 0 puts the whole
    row at its mean. At most ``bins`` times the edges leave a task.
    """
    lo, hi = (F.lit(float(v)) for v in x_limits)
    at = F.col(x).cast("double")
    placed = df.where(at.between(lo, hi) & (F.abs(mean) < F.lit(float("inf"))) & (F.abs(sd) < F.lit(float("inf")))).select(
        interval_index(at, lo, hi, bins).alias("x_bin"), F.col(mean).cast("double").alias("mean"), F.col(sd).cast("double").alias("sd")
    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((bins + 1, len(edges))), np.zeros(bins + 1, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                group, centre, spread = (part.column(c).to_numpy(zero_copy_only=False) for c in ("x_bin", "mean", "sd"))
                away = edges - centre[:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    share = np.where(spread[:, None] > 0, distribution(np.clip(away / spread[:, None], -40, 40)), away >= 0)
                np.add.at(total, group, share)
                rows += np.bincount(group, minlength=bins + 1)
        used = np.flatnonzero(rows)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, len(edges)).astype(np.int32)), pa.array(np.tile(np.arange(len(edges)), len(used)).astype(np.int32)),
                 pa.array(total[used].ravel()), pa.array(np.repeat(rows[used], len(edges)))],
                ["x_bin", "edge", "below", "n"],
            )

    sums = placed.mapInArrow(add, "x_bin int, edge int, below double, n long")
    return sums.groupBy("x_bin", "edge").agg(F.sum("below").alias("below"), F.sum("n").alias("n"))


def predictive_density(
    df: DataFrame, x: str, mean: str, sd: str, bins: tuple[int, int], x_limits: tuple[float, float], y_limits: tuple[float, float]
) -> DataFrame:
    """E13 of predictions: expected responses per cell, their share of all that fall in the limits, and over the largest."""
    edges = np.linspace(*y_limits, bins[1] + 1)
    below = expected_below(df, x, mean, sd, bins[0], x_limits, edges)
    before = F.lag("below").over(Window.partitionBy("x_bin").orderBy("edge"))
    cells = below.withColumn("expected", F.col("below") - before).where("edge > 0")
    everything = Window.partitionBy()    # one row a cell
    width, height = ((b - a) / n for (a, b), n in zip((x_limits, y_limits), bins))
    return cells.select(
        "x_bin",
        F.col("edge").alias("y_bin"),
        (F.lit(float(x_limits[0])) + (F.col("x_bin") - 1) * width).alias("x_lo"),
        (F.lit(float(y_limits[0])) + (F.col("edge") - 1) * height).alias("y_lo"),
        "expected",
        F.try_divide("expected", F.sum("expected").over(everything)).alias("density"),
        F.try_divide("expected", F.max("expected").over(everything)).alias("ndensity"),
    ).withColumn("log_ndensity", F.when(F.col("ndensity") > 0, log_share(F.col("ndensity"))))


def predictive_boxes(
    df: DataFrame, x: str, mean: str, sd: str, bins: int, x_limits: tuple[float, float], y_limits: tuple[float, float], edges: int = EDGES
) -> DataFrame:
    """E14 of predictions: quartiles per bin of x, fences 1.5 IQR beyond them, and the responses expected outside those.

    The distribution function is taken linear between ``edges`` even steps over
    ``y_limits``, which have to hold the quartiles: a quantile beyond them is NULL.
    """
    grid = np.linspace(*y_limits, edges + 1)
    step = float(grid[1] - grid[0])
    below = expected_below(df, x, mean, sd, bins, x_limits, grid)
    curve = below.groupBy("x_bin", "n").agg(F.sort_array(F.collect_list(F.struct("edge", "below"))).alias("curve"))
    n, share = F.col("n"), F.transform("curve", lambda p: p["below"] / F.col("n"))

    def quantile(q: float):
        i = F.size(F.filter("share", lambda s: s <= q))    # the last edge with no more than q
        lo, hi = F.get("share", i - 1), F.get("share", i)
        return F.when(i.between(1, edges), F.lit(float(y_limits[0])) + (i - 1 + (F.lit(q) - lo) / (hi - lo)) * step)

    def share_at(y):
        place = (y - F.lit(float(y_limits[0]))) / step
        i = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(edges - 1)).cast("int")
        inside = F.least(F.greatest(place - i, F.lit(0.0)), F.lit(1.0))
        return F.get("share", i) + inside * (F.get("share", i + 1) - F.get("share", i))

    boxes = curve.withColumn("share", share).select("x_bin", n, "share", quantile(0.25).alias("q1"), quantile(0.5).alias("median"), quantile(0.75).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fenced = boxes.withColumns({"fence_lo": F.col("q1") - reach, "fence_hi": F.col("q3") + reach})
    outside = n * (share_at(F.col("fence_lo")) + 1 - share_at(F.col("fence_hi")))
    return fenced.select("x_bin", "n", "q1", "median", "q3", "fence_lo", "fence_hi", outside.alias("outside"))
