import datetime

from gridweave.streaming import edits

T = datetime.datetime(2024, 1, 1, 12)


def rows(*minutes):
    return [(1 + k % 2, T + datetime.timedelta(minutes=m), f"e{k}") for k, m in enumerate(minutes)]


def test_debounce_in_a_stream(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_type string"
    spark.createDataFrame(rows(0, 1, 5, 40, 50, 200, 400), schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = edits.debounced(stream, "20 minutes", lateness="5 minutes").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.user_id, r.started, r.edits) for r in spark.sql("select * from bursts").collect()}
    batch = {(r.user_id, r.started, r.edits) for r in edits.debounced(spark.createDataFrame(rows(0, 1, 5, 40, 50, 200, 400), schema), "20 minutes").collect()}
    assert got and got <= batch


def test_latest_in_a_stream(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_type string"
    spark.createDataFrame(rows(0, 1, 5, 40), schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = edits.latest_sink(stream, str(tmp_path / "out"), "user_id", "ts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.user_id, r.event_type) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "e2"), (2, "e3")}
