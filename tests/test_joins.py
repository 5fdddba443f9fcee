from datetime import datetime, timedelta

from pyspark.sql import functions as F

from helpers import hour_of_minutes
from skyledger.operators.joins import at_instants, attach_summary, interval_join, left_join_suffixed, outside_intervals, spread_join
from skyledger.operators.rollup import STATISTICS
from skyledger.plans.station import combine, complete_hours, event_windows, high_gust_windows

HOURS = "site string, year int, month int, day int, hour int, t_2m double, t_10m double, p double, wind_spd double"


def hours(spark, *rows):
    return spark.createDataFrame([("A", 2020, 1, 1, h, *rest) for h, *rest in rows], HOURS)


def test_left_join_keeps_unmatched_hours(spark):
    summary = complete_hours(hour_of_minutes(spark, range(60), 0))
    table = hours(spark, (0, -10.0, -9.0, 1000.0, 5.0), (1, -10.0, -9.0, 1000.0, 5.0))
    rows = attach_summary(table, summary).orderBy("hour").collect()
    assert rows[0].wind_max == 59.0 and all(rows[1][c] is None for c in STATISTICS)


def test_missing_keys_match_each_other(spark):
    left = spark.createDataFrame([(None, 2020, 1, 1, 0, 1.0)], "site string, year int, month int, day int, hour int, x double")
    right = spark.createDataFrame([(None, 2020, 1, 1, 0, 9.0)], "site string, year int, month int, day int, hour int, y double")
    assert attach_summary(left, right).first().y == 9.0


def test_combine_variants(spark):
    minutes = hour_of_minutes(spark, range(60), 0).unionAll(hour_of_minutes(spark, range(60), 1, site="B"))
    summary = complete_hours(minutes)
    table = hours(
        spark, (0, -10.0, -9.0, 1000.0, 5.0), (1, -10.0, -9.0, 1000.0, 5.0), (2, -1.0, 0.0, 1000.0, 5.0),
        (0, None, -9.0, 1000.0, 5.0),
    )
    assert [r.hour for r in combine(table, summary).collect()] == [0]
    loose = combine(table, summary, ("t_2m", "wind_spd"))
    # hour 1 is complete at another site only, and instants are compared without the site
    assert sorted(r.hour for r in loose.collect()) == [0, 1]
    assert [r.hour for r in combine(table, summary, ("t_2m", "wind_spd"), by_site=True).collect()] == [0]
    assert loose.where("hour = 1").first().wind_sd is None


def test_combine_equals_join_then_semi_join(spark):
    minutes = hour_of_minutes(spark, range(60), 0).unionAll(hour_of_minutes(spark, range(60), 3))
    summary = complete_hours(minutes)
    table = hours(spark, *((h, float(h), 0.0, 1000.0, 5.0) for h in range(6)))
    every = combine(table, summary, ("t_2m", "wind_spd"))
    for short in (combine(table, summary), combine(table, summary, ("t_2m", "wind_spd"), by_site=True)):
        long = at_instants(every, summary, by_site=True)
        assert sorted(map(tuple, short.collect())) == sorted(map(tuple, long.collect()))
        assert sorted(r.hour for r in short.collect()) == [0, 3]


def test_semi_join_stays_one(spark, conf, plan):
    conf(autoBroadcastJoinThreshold="-1")
    summary = complete_hours(hour_of_minutes(spark, range(60), 0))
    text = plan(combine(hours(spark, (0, 1.0, 1.0, 1.0, 1.0)), summary, ("t_2m", "wind_spd")))
    assert "LeftSemi" in text and "Cartesian" not in text and "NestedLoop" not in text


def test_skewed_hour_is_split(spark, conf, plan):
    conf(
        autoBroadcastJoinThreshold="-1",
        shuffle__partitions="16",
        adaptive__skewJoin__skewedPartitionFactor="3",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        adaptive__advisoryPartitionSizeInBytes="10KB",
        adaptive__coalescePartitions__minPartitionSize="5KB",
    )
    summary = complete_hours(
        hour_of_minutes(spark, range(60), 0).unionAll(hour_of_minutes(spark, range(60), 1)), 60
    )
    table = spark.range(0, 40000, 1, 8).selectExpr(
        "'A' as site", "2020 as year", "1 as month", "1 as day", "cast(if(id % 3 = 0, 0, id % 24) as int) as hour",
        "rand(5) as t_2m", "rand(6) as wind_spd",
    )
    joined = attach_summary(table, summary)
    rows = joined.collect()
    assert "skew=true" in plan(joined)
    assert len(rows) == 40000
    assert all((r.wind_max == 59.0) == (r.hour in (0, 1)) for r in rows)


def test_suffixes(spark):
    left = spark.createDataFrame([("A", 1, 2.0), ("B", 2, 3.0)], "site string, k int, wind_sd double")
    right = spark.createDataFrame([("A", 20.0, 7)], "site string, wind_sd double, extra int")
    out = left_join_suffixed(left, right, ["site"])
    assert set(out.columns) == {"site", "k", "wind_sd_x", "wind_sd_y", "extra"}
    assert {r.site: (r.wind_sd_x, r.wind_sd_y, r.extra) for r in out.collect()} == {"A": (2.0, 20.0, 7), "B": (3.0, None, None)}


def brute_pairs(rows, windows):
    return sorted((r[0], w[3]) for r in rows for w in windows if r[1] == w[0] and w[1] <= r[2] <= w[2])


def test_interval_join_matches_brute_force(spark, conf, plan):
    start = datetime(2020, 1, 1)
    rows = [(i, "AB"[i % 2], start + timedelta(minutes=37 * i)) for i in range(400)]
    windows = [
        ("AB"[i % 2], start + timedelta(hours=5 * i), start + timedelta(hours=5 * i + 3 * (i % 30)), i) for i in range(40)
    ]
    windows.append(("A", start + timedelta(hours=9), start, 99))    # ends before it starts
    r = spark.createDataFrame(rows, "id int, site string, ts timestamp_ntz")
    w = spark.createDataFrame(windows, "site string, window_start timestamp_ntz, window_end timestamp_ntz, w int")
    out = interval_join(r, w)
    assert sorted((x.id, x.w) for x in out.collect()) == brute_pairs(rows, windows[:-1])
    conf(autoBroadcastJoinThreshold="-1")
    text = plan(interval_join(r, w))
    assert "SortMergeJoin [site" in text and "NestedLoop" not in text and "Cartesian" not in text
    outside = outside_intervals(
        r, w.select("site", F.col("window_start").alias("from_ts"), F.col("window_end").alias("to_ts"))
    )
    held = {i for i, _ in brute_pairs(rows, windows[:-1])}
    assert sorted(x.id for x in outside.collect()) == sorted(i for i, *_ in rows if i not in held)


def test_windows_around_high_hours(spark):
    minutes = hour_of_minutes(spark, [0, 20] * 30, 8).unionAll(hour_of_minutes(spark, [1] * 60, 1))
    minutes = minutes.unionAll(hour_of_minutes(spark, [1] * 60, 14)).unionAll(hour_of_minutes(spark, [1] * 60, 2, day=2))
    timed = minutes.withColumn("ts", F.make_timestamp_ntz("year", "month", "day", "hour", "minute", F.lit(0)))
    summary = complete_hours(minutes)
    assert high_gust_windows(summary, F.col("wind_sd") > 2).first().window_start == datetime(2020, 1, 1, 2)
    around = event_windows(timed, summary, F.col("wind_sd") > 2)
    # the whole gusty hour, and of 14:00 only the minute six hours later
    assert around.groupBy("hour").count().orderBy("hour").collect() == [(8, 60), (14, 1)]


def test_spread_join(spark):
    rows = spark.range(0, 3000, 1, 4).selectExpr("if(id % 3 = 0, 'hot', cast(id % 50 as string)) as g", "id % 7 as v")
    table = rows.select("g").distinct().withColumn("size", F.length("g"))
    out = spread_join(rows, table, ["g"])
    assert out.agg(F.sum("_w")).first()[0] == 3000
    assert out.where("size <> length(g)").count() == 0
