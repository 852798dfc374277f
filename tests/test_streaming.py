"""The daily feed against a batch sum."""

from pyspark.sql import functions as F

from tidegrain.streaming.exposures import daily_sums


def test_daily_sums(spark, tmp_path):
    rows = [("2015-01-01 01:00:00", 1, 2.0), ("2015-01-01 05:00:00", 2, None), ("2015-01-02 03:00:00", 1, 4.0)]
    feed = spark.createDataFrame(rows, "t string, unit int, v double").select(F.col("t").cast("timestamp").alias("ts"), "unit", "v")
    feed.write.parquet(str(tmp_path / "in"))
    weights = spark.createDataFrame([(7, 1, 0.5), (7, 2, 0.5), (8, 1, 1.0)], "episode_id int, unit int, weight double")
    stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in"))
    query = daily_sums(stream, weights, "v").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.episode_id, str(r.day.start.date())): (r.weighted, r.weight) for r in spark.table("daily").collect()}
    assert got == {(7, "2015-01-01"): (1.0, 0.5), (8, "2015-01-01"): (2.0, 1.0), (7, "2015-01-02"): (2.0, 0.5), (8, "2015-01-02"): (4.0, 1.0)}
