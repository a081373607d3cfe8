from datetime import datetime

from millrace.session import ship_package
from millrace.streaming import best, ordered


def test_best_loss_over_a_stream(spark, tmp_path):
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "run string, step long, loss double"
    for i, rows in enumerate(([("a", 1, 5.0), ("a", 2, 4.95)], [("a", 3, 4.0), ("b", 1, 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = best.accepted_steps(stream, 0.1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1, 5.0), ("a", 3, 4.0), ("b", 1, 1.0)}


def test_windowed_counts_leave_out_what_is_later_than_the_watermark(spark, tmp_path):
    schema = "at timestamp, kind string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = best.windowed_counts(stream, "at", "kind").select("window.start", "kind", "n")
    moment = lambda hour, minute: datetime(2024, 1, 1, hour, minute)
    for rows in ([(moment(1, 5), "a"), (moment(1, 50), "a"), (moment(1, 55), "b")], [(moment(9, 0), "a")], [(moment(1, 10), "a"), (moment(20, 0), "a")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(moment(1, 0), "a", 2), (moment(1, 0), "b", 1), (moment(9, 0), "a", 1)}


def test_steps_are_taken_by_event_time_and_late_ones_told(spark, tmp_path):
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "run string, step long, loss double, at timestamp"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    told = ordered.accepted_in_order(stream, "at", "10 minutes", 0.5)
    moment = lambda m: datetime(2024, 1, 1, m // 60, m % 60)
    arrivals = [
        [("a", 3, 4.0, moment(3)), ("a", 1, 5.0, moment(1)), ("b", 1, 1.0, moment(2))],  # out of order in a batch
        [("a", 2, 3.0, moment(2)), ("a", 4, 2.8, moment(4)), ("a", 5, float("nan"), moment(5))],  # and across batches
        [("a", 9, 1.0, moment(60)), (None, 1, 0.0, moment(61)), ("a", None, 0.0, moment(61))],
        [("a", 6, 0.1, moment(6)), ("a", 10, 0.9, moment(61)), ("a", 11, 0.2, moment(59)), ("b", 2, 0.2, moment(120))],
        [("b", 3, -5.0, moment(300))],
    ]
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        out.trigger(availableNow=True).start().awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # step 3 (4.0) comes after step 2 (3.0) in time; step 11 before 9 and 10; the last step of b still waits
    assert got == [("a", 1, 5.0, "kept"), ("a", 2, 3.0, "kept"), ("a", 6, 0.1, "late"), ("a", 11, 0.2, "kept"), ("b", 1, 1.0, "kept"), ("b", 2, 0.2, "kept")]
