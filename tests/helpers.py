from pyspark.sql import functions as F


def hour_of_minutes(spark, speeds, hour=0, site="A", day=1):
    """A minute table with one hour's readings."""
    rows = [(site, 2020, 1, day, hour, i, None if v is None else float(v)) for i, v in enumerate(speeds)]
    return spark.createDataFrame(rows, "site string, year int, month int, day int, hour int, minute int, wind_spd double")


def collect_by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


def column(df, name, order=None):
    return [r[name] for r in (df.orderBy(order) if order else df).collect()]


def ids(spark, n, parts=4):
    return spark.range(0, n, 1, parts).withColumn("u", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000003)) / 1000003.0)
