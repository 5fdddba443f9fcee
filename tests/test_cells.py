import pytest
from pyspark.sql import functions as F

from helpers import ids
from skyledger.operators.cells import add_cells, merged_cells, read_cells, trend_cells
from skyledger.plans.station import (
    MEAN_MEASURES,
    TREND_MEASURES,
    mean_trends_of_cells,
    month_mean_trends,
    monthly_trends,
    trend_events,
    trends_of_cells,
)

MEASURES = sorted({*TREND_MEASURES, *MEAN_MEASURES})


def hours(spark, n=6000):
    year = (1994 + F.col("id") % 7).cast("int")
    return ids(spark, n).select(
        F.concat(F.lit("S"), F.col("id") % 2).alias("site"), year.alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"),
        (1e6 + F.col("u") * 3 + F.col("id") % 7).alias("t_2m"), F.when(F.col("id") % 11 > 0, F.col("u") * 9).alias("wind_spd"),
        (F.col("u") * F.col("u") * 5).alias("wind_sd"), (900 + F.col("u") * 100).alias("p"),
    )


def numbers(df, keys):
    return {tuple(r[k] for k in keys): [r[c] for c in df.columns if c not in keys] for r in df.collect()}


def close(found, want):
    assert found.keys() == want.keys() and found
    for k in want:
        assert found[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9, nan_ok=True), k


def stored(spark, tmp_path, *parts):
    path = str(tmp_path / "cells")
    for name, rows in parts:
        add_cells(trend_cells(rows, MEASURES, trend_events(2.0)), path, name)
    return read_cells(spark, path)


def test_a_year_added_equals_a_recount(spark, tmp_path):
    every = hours(spark)
    cells = stored(spark, tmp_path, *((f"y{y}", every.where(F.col("year") == y)) for y in range(1994, 2001)))
    keys = ["metric", "month"]
    close(numbers(trends_of_cells(cells), keys), numbers(monthly_trends(every), keys))
    close(numbers(mean_trends_of_cells(cells), keys), numbers(month_mean_trends(every), keys))


def test_parts_of_a_cell_merge_and_batches_replace_themselves(spark, tmp_path):
    every = hours(spark)
    parts = [(f"b{k}", every.where(F.expr(f"pmod(xxhash64(t_2m), 3) = {k}"))) for k in range(3)]
    cells = stored(spark, tmp_path, *parts, parts[1])
    keys = ["site", "month", "year"]
    events = list(trend_events())
    close(numbers(merged_cells(cells.drop("batch"), MEASURES, events), keys), numbers(merged_cells(trend_cells(every, MEASURES, trend_events(2.0)), MEASURES, events), keys))


def test_only_the_new_files_are_read(spark, tmp_path, plan):
    hours(spark).write.partitionBy("year").parquet(str(tmp_path / "h"))
    new = spark.read.parquet(str(tmp_path / "h")).where("year = 2000")
    text = plan(trend_cells(new, MEASURES, trend_events()))
    assert "PartitionFilters: [isnotnull(year" in text and text.count("FileScan") == 1


def test_cells_without_values(spark):
    none = hours(spark, 100).withColumn("t_2m", F.lit(None).cast("double"))
    merged = merged_cells(trend_cells(none, MEASURES, trend_events()), MEASURES, list(trend_events())).collect()
    assert all(r.t_2m_w == 0 and r.t_2m_mean is None and r.thaw_count == 0 for r in merged)
    assert merged_cells(trend_cells(none.limit(0), MEASURES, trend_events()), MEASURES, list(trend_events())).count() == 0
