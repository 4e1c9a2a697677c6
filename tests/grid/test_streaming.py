from cellward.streaming import events

ROWS = [(1, "2024-01-01 00:10:00", 1, "view", 1.0), (2, "2024-01-01 00:50:00", 1, "view", 2.0), (3, "2024-01-01 00:55:00", 2, "click", 4.0), (4, "2024-01-01 03:00:00", 1, "view", 8.0)]


def test_stream_and_batch_agree(spark, tmp_path):
    batch = spark.createDataFrame(ROWS, "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "cast(t as timestamp) ts", "user_id", "event_type", "value")
    batch.write.parquet(f"{tmp_path}/events")
    want = sorted(map(tuple, events.hourly(batch).collect()))
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/events")
    query = events.hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("hours").collect())) == want
    assert sorted((r.user_id, r.n) for r in events.sessions(batch).collect()) == [(1, 1), (1, 1), (1, 1), (2, 1)]
    assert events.first_seen(batch.union(batch)).count() == 4
