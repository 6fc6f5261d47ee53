from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitelode.operators import jobs, metrics
from sitelode.streaming import streams

NOW = datetime(2024, 5, 2, 12, 0, 0)
MINUTE = timedelta(minutes=1)
EVENT = "job_id int, seq int, ts timestamp_ntz, status string, error_message string, discovered_links int"


def batches(spark, tmp_path, schema, *parts):
    """A folder of parquet files, read one file per micro-batch in order."""
    folder = str(tmp_path / "in")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), folder


def test_table_stream_takes_a_folder_or_one_file(spark, tmp_path):
    spark.range(50).repartition(3).write.parquet(str(tmp_path / "folder"))
    single = next((tmp_path / "folder").glob("part-*.parquet"))
    for name, path in (("folder", tmp_path / "folder"), ("file", single)):
        stream = streams.table_stream(spark, str(path), maxFilesPerTrigger="1")
        out = str(tmp_path / f"out-{name}")
        streams.run_append(stream, out, str(tmp_path / f"state-{name}")).awaitTermination()
        assert spark.read.parquet(out).count() == spark.read.parquet(str(path)).count()


def test_job_state_stream_equals_batch(spark, tmp_path):
    parts = [
        [(1, 1, NOW, "running", None, None), (2, 2, NOW, "running", None, None)],
        [(1, 3, NOW + MINUTE, "failed", "", 0), (3, 4, NOW, "retry", "no", 5)],
        [(1, 5, NOW + 2 * MINUTE, "completed", "warned", None), (2, 0, NOW - MINUTE, "failed", "late", 3)],
    ]
    stream, folder = batches(spark, tmp_path, EVENT, *parts)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    streams.run_updates(streams.stream_job_state(stream), out, state).awaitTermination()
    latest = streams.latest_updates(spark, out)
    wanted = jobs.job_event_fold(spark.read.schema(EVENT).parquet(folder))
    columns = sorted(wanted.columns)
    assert {tuple(r) for r in latest.select(columns).collect()} == {tuple(r) for r in wanted.select(columns).collect()}
    # running again over nothing new, and a repeated batch, change nothing
    streams.run_updates(streams.stream_job_state(stream), out, state).awaitTermination()
    assert streams.latest_updates(spark, out).count() == 3


def test_request_metrics_stream_equals_batch_for_closed_windows(spark, tmp_path):
    schema = "ts timestamp_ntz, is_error boolean, response_time double"
    parts = [
        [(NOW + i * MINUTE, i % 2 == 0, float(i)) for i in range(30)],
        [(NOW + i * MINUTE, False, 1.0) for i in range(30, 60)],
        [(NOW + 80 * MINUTE, False, 1.0)],
        [(NOW, True, 99.0)],  # far behind the watermark: dropped
    ]
    stream, folder = batches(spark, tmp_path, schema, *parts)
    out = str(tmp_path / "out")
    streams.run_append(streams.stream_request_metrics(stream, 5), out, str(tmp_path / "state")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    log = spark.read.schema(schema).parquet(folder).filter("response_time <> 99.0")
    closed = metrics.request_metrics(log, 5).filter(F.col("bucket_start") < F.lit(str(NOW + 70 * MINUTE)).cast("timestamp_ntz"))
    assert got == {tuple(r) for r in closed.collect()} and len(got) == 12


def test_stream_times_are_free_of_the_session_zone(spark):
    frame = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30, 0, 5),)], "ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            back = frame.select(streams.zone_free(streams.event_time("ts")).alias("t")).first().t
            assert back == datetime(2024, 3, 10, 2, 30, 0, 5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_new_address_stream_drops_repeats(spark, tmp_path):
    schema = "address string, discovered_at timestamp_ntz"
    parts = [[("a", NOW), ("b", NOW)], [("a", NOW + MINUTE), ("c", NOW + MINUTE)], [("b", NOW + 2 * MINUTE)]]
    stream, _ = batches(spark, tmp_path, schema, *parts)
    out = str(tmp_path / "out")
    streams.run_append(streams.stream_new_addresses(stream), out, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.address for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
