from pyspark.sql import functions as F

from skyledger.schema import HOUR_SCHEMA, MINUTE_SCHEMA
from skyledger.sources.tables import grid_values, literal_table, read_table, write_table
from skyledger.sources.text import read_hour_text, read_minute_text

MINUTE_LINES = """A01 2004 12 1 12 0 250 10.4 98 1001.2 -20.1 -19.8 -19.5 80 0
   A01  2004 12  1 12   1 -999   -999.0  -9 -999 -998.9 -999.9 -999 -99 -99

A01 2004 12 1 12 2 250 -5.0 -9.5 1001 -99.0 -19.8 -19.5 -100 -0.5
A01 2004 12 x 12 3 250 oops 98
\t\t
A01 2004 12 1 12 4 1 2 3 4 5 6 7 8 9 surplus cells
"""

HOUR_LINES = """A01 2004 12 1 12 250 10.4 98 1001.2 -20.1 -19.8 -19.5 80 0
A01 2004 12 1 13 -99 -99.9 -9 -999 -99.0 -98.9 -99.9 -99 -99
"""


def test_minute_lines(spark, tmp_path):
    path = tmp_path / "minutes.txt"
    path.write_text(MINUTE_LINES)
    df = read_minute_text(spark, str(path))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in MINUTE_SCHEMA]
    rows = sorted(df.collect(), key=lambda r: r.minute)
    assert len(rows) == 5
    assert rows[0][:8] == ("A01", 2004, 12, 1, 12, 0, 250.0, 10.4) and rows[0].precip == 0.0
    sentinel = rows[1]
    assert sentinel.t_2m == -998.9    # above the minute threshold
    assert all(sentinel[c] is None for c in ("wind_dir", "wind_spd", "wind_stead", "p", "t_10m", "t_top", "rh", "precip"))
    assert rows[2].wind_spd == -5.0 and rows[2].t_2m == -99.0    # not sentinels of the minute table
    assert rows[2].wind_stead is None and rows[2].rh is None and rows[2].precip == -0.5
    assert rows[3].day is None and rows[3].wind_spd is None and rows[3].wind_stead == 98.0 and rows[3].p is None
    assert rows[4].precip == 9.0


def test_hour_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text(HOUR_LINES.splitlines()[0] + "\n")
    (tmp_path / "b.txt").write_text(HOUR_LINES.splitlines()[1] + "\n")
    df = read_hour_text(spark, str(tmp_path / "*.txt"))
    assert df.columns == HOUR_SCHEMA.names
    first, second = sorted(df.collect(), key=lambda r: r.hour)
    assert first.t_2m == -20.1 and second.t_10m == -98.9
    assert second.t_2m is None and second.wind_spd is None and second.wind_dir is None


def test_stored_table_is_pruned_by_year(spark, tmp_path, plan):
    rows = [("A", y, m, 1, 0, float(y)) for y in (2001, 2002, 2003) for m in (1, 2)]
    df = spark.createDataFrame(rows, "site string, year int, month int, day int, hour int, v double")
    path = str(tmp_path / "stored")
    write_table(df, path)
    back = read_table(spark, path).where("year = 2002").select("site", "month", "v")
    assert sorted(tuple(r) for r in back.collect()) == [("A", 1, 2002.0), ("A", 2, 2002.0)]
    assert "PartitionFilters: [isnotnull(year" in plan(back)
    assert read_table(spark, path).count() == 6


def test_literal_table_and_grid(spark):
    table = literal_table(spark, {"month": [1, 2], "slope": [0.5, -0.5]}, "month int, slope double")
    assert [tuple(r) for r in table.orderBy("month").collect()] == [(1, 0.5), (2, -0.5)]
    ends = spark.range(1).select(F.lit(-49.0).alias("lo"), F.lit(22.8).alias("hi"))
    grid = ends.select(grid_values(F.col("lo"), F.col("hi"), 30)).first()[0]
    assert len(grid) == 30 and grid[0] == -49.0 and abs(grid[-1] - 22.8) < 1e-12
    assert abs(grid[1] - grid[0] - 71.8 / 29) < 1e-12
