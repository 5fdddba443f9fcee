from helpers import hour_of_minutes
from skyledger.plans.station import complete_hours
from skyledger.streaming.hourly import stream_complete_hours


def test_closed_hours_equal_the_batch(spark, tmp_path):
    """Files arrive one by one; hours come out once, when the watermark has passed them."""
    speeds = [(i * 7 % 30) / 2 for i in range(60)]
    hours = [hour_of_minutes(spark, speeds, h) for h in range(3)]
    hours.append(hour_of_minutes(spark, speeds[:59], 3))
    hours.append(hour_of_minutes(spark, [*speeds[:30], None, *speeds[31:]], 4))
    hours += [hour_of_minutes(spark, speeds, h) for h in range(5, 9)]
    for h in hours:
        h.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(hours[0].schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = (
        stream_complete_hours(stream, delay="2 hours")
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(240)
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("hour").collect()
    assert [r.hour for r in found] == [0, 1, 2, 5, 6]    # 7 and 8 are still open, 3 and 4 incomplete
    batch = complete_hours(spark.read.parquet(str(tmp_path / "in"))).where("hour in (0, 1, 2, 5, 6)")
    assert [r.asDict() for r in found] == [r.asDict() for r in batch.orderBy("hour").collect()]
