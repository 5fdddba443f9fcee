"""The most frequent keys of a counted table, without ordering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 16


def most_frequent(counted: DataFrame, most: int, n: str = "n") -> DataFrame:
    """Rows of ``counted`` above the lowest count at which no more than ``most`` rows are left.

    Counts are binned by sixteenths of their base-2 logarithm, so a few hundred
    bins reach the driver; rows of one bin are in or out together.
    """
    level = F.floor(F.log2(F.col(n)) * _STEPS)
    bins = counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()
    taken, least = 0, None
    for row in sorted(bins, key=lambda r: -r["level"]):
        taken += row["rows"]
        if taken > most:
            break
        least = row["level"]
    return counted.where(F.lit(False) if least is None else level >= least)
