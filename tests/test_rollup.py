import statistics
from datetime import datetime
from functools import reduce

import pytest
from pyspark.sql import DataFrame

from helpers import collect_by, hour_of_minutes
from skyledger.operators.rollup import STATISTICS, hourly_summary
from skyledger.plans.catalog import registered
from skyledger.plans.station import complete_hours


def test_full_hour(spark):
    speeds = [(i % 25) / 2 for i in range(60)]
    row = hourly_summary(hour_of_minutes(spark, speeds)).first()
    assert row.wind_mean == pytest.approx(statistics.mean(speeds))
    assert row.wind_sd == pytest.approx(statistics.stdev(speeds))
    assert row.wind_med == statistics.median(speeds)
    assert (row.wind_max, row.wind_min) == (max(speeds), min(speeds))
    assert row.gust_time == sum(v >= 10 for v in speeds)
    assert (row.nrow, row.na_ct, row.date) == (60, 0, datetime(2020, 1, 1))


def test_missing_reading_spoils_the_hour(spark):
    minutes = hour_of_minutes(spark, [1, 2, None, -5])
    row = hourly_summary(minutes).first()
    assert all(row[c] is None for c in STATISTICS) and (row.nrow, row.na_ct) == (4, 2)
    kept = hourly_summary(minutes, na="skip").first()
    assert (kept.wind_mean, kept.wind_max, kept.gust_time) == (1.5, 2.0, 0)


def test_single_row_has_no_sd(spark):
    row = hourly_summary(hour_of_minutes(spark, [11])).first()
    assert row.wind_sd is None and row.wind_mean == 11.0 and row.gust_time == 1


def test_refined_gusts(spark):
    steady, squall = [12] * 60, [4] * 50 + [15] * 10
    minutes = hour_of_minutes(spark, steady, 0).unionAll(hour_of_minutes(spark, squall, 1))
    minutes = minutes.unionAll(hour_of_minutes(spark, [1] * 60, 2)).unionAll(hour_of_minutes(spark, [20, None], 3))
    simple = collect_by(hourly_summary(minutes), "hour")
    refined = collect_by(hourly_summary(minutes, gust="refined"), "hour")
    assert [simple[h]["gust_time"] for h in range(4)] == [60, 10, 0, None]
    assert [refined[h]["gust_time"] for h in range(4)] == [0, 10, 0, None]
    for h in range(4):
        same = [c for c in simple[h] if c != "gust_time"]
        assert all(simple[h][c] == refined[h][c] for c in same)
    assert list(refined[0]) == list(simple[0])


def test_refined_gusts_keep_hours_without_site(spark):
    minutes = hour_of_minutes(spark, [4, 4, 15], site=None)
    assert hourly_summary(minutes, gust="refined").first().gust_time == 1


def test_only_complete_hours(spark):
    minutes = hour_of_minutes(spark, range(60), 0).unionAll(hour_of_minutes(spark, range(59), 1))
    minutes = minutes.unionAll(hour_of_minutes(spark, [*range(59), None], 2)).unionAll(hour_of_minutes(spark, [*range(59), -1], 3))
    assert [r.hour for r in complete_hours(minutes).collect()] == [0]


def test_minutes_are_read_once_and_counted_before_they_move(spark, tmp_path, plan):
    hour_of_minutes(spark, range(60)).write.parquet(str(tmp_path / "m"))
    minutes = spark.read.parquet(str(tmp_path / "m"))
    for gust in ("simple", "refined"):
        text = plan(hourly_summary(minutes, gust=gust))
        assert text.count("FileScan") == 1 and "ObjectHashAggregate" not in text
        assert text.rindex("partial_count") > text.rindex("Exchange hashpartitioning")    # the last lines run first
        assert "minute" not in text.split("ReadSchema")[1]    # only the needed columns are read


def test_medians_of_repeated_and_even_counts(spark):
    cases = [[1], [1, 2], [1, 1, 1, 9], [3, 1, 2], [5, 5, 1, 1], [2, None, 4], [None], [0, 0, 0.5, 0.5, 7, 7]]
    minutes = [hour_of_minutes(spark, c, h) for h, c in enumerate(cases)]
    rows = collect_by(hourly_summary(reduce(DataFrame.unionAll, minutes), na="skip"), "hour")
    for h, c in enumerate(cases):
        known = [v for v in c if v is not None]
        assert rows[h]["wind_med"] == (statistics.median(known) if known else None)
        assert rows[h]["wind_mean"] == (pytest.approx(statistics.mean(known)) if known else None)
        assert rows[h]["wind_sd"] == (pytest.approx(statistics.stdev(known)) if len(known) > 1 else None)


def test_crowded_hour(spark):
    """A third of all rows in one hour: partial states stay one entry per distinct reading."""
    crowd = spark.range(0, 30000, 1, 8).selectExpr(
        "'A' as site", "2020 as year", "1 as month", "1 as day", "0 as hour", "id % 13 + 0.5D as wind_spd"
    )
    rest = spark.range(0, 60000, 1, 8).selectExpr(
        "'A' as site", "2020 as year", "1 as month", "cast(2 + id % 20 as int) as day",
        "cast(id % 24 as int) as hour", "id % 13 + 0.5D as wind_spd",
    )
    for gust in ("simple", "refined"):
        row = hourly_summary(crowd.unionAll(rest), gust=gust).where("day = 1").first()
        assert (row.nrow, row.wind_med) == (30000, 6.5)
        assert row.gust_time == sum(i % 13 + 0.5 >= (10 if gust == "simple" else max(10, 1.5 * row.wind_mean)) for i in range(30000))


def test_sums_of_an_hour_move_no_readings(spark, plan):
    minutes = hour_of_minutes(spark, [1, 12, None, -5], 0).unionAll(hour_of_minutes(spark, [11, 3, 30], 1, site=None))
    for na in ("propagate", "skip"):
        few = hourly_summary(minutes, na=na, statistics=("wind_max", "gust_time"))
        assert few.columns == ["site", "year", "month", "day", "hour", "gust_time", "wind_max", "nrow", "na_ct", "date"]
        assert plan(few).count("Exchange") == 1 and "Window" not in plan(few)
        every = hourly_summary(minutes, na=na).select(*few.columns)
        assert few.dtypes == every.dtypes and sorted(few.collect(), key=str) == sorted(every.collect(), key=str)
    assert hourly_summary(minutes, statistics=("wind_med",)).columns[5:] == ["wind_med", "nrow", "na_ct", "date"]


def test_stability_counts_no_readings(spark, plan):
    text = plan(registered()["stability"](spark, "/root/testdata/sf0.001"))
    assert text.count("lineitem.parquet") == 1 and "speed#" not in text.split("lineitem.parquet")[0].split("Join")[1]


def test_hours_are_not_summed_up_before_they_meet(spark, plan):
    """With sums alone in use, a partial sum by hour would hold every reading's hour a second time."""
    text = plan(hourly_summary(hour_of_minutes(spark, range(60))).select("site", "hour", "gust_time"))
    counting = text.split("Exchange")[1]
    assert counting.count("HashAggregate") == 1


def test_partitions_of_sorted_hours_are_not_merged(spark, conf, plan):
    conf(shuffle__partitions="7")
    summary = hourly_summary(hour_of_minutes(spark, range(60)))
    assert summary.collect()[0].wind_max == 59.0
    text = plan(summary)
    assert "REPARTITION_BY_NUM" in text and text.split("Initial Plan")[0].count("coalesced") <= 1


def test_instants_of_complete_hours_roll_up_once(spark, plan):
    assert "lineitem.parquet" not in plan(registered()["combined_any_site"](spark, "/root/testdata/sf0.001"))
