"""Streaming forms of the log operators; each gives the rows of its batch twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelode.operators.jobs import job_event_fold
from sitelode.operators.metrics import request_aggregates
from sitelode.sources.catalog_io import is_folder


def event_time(column: Column | str) -> Column:
    """A zone-free time read as UTC: watermarks need an absolute time."""
    column = F.col(column) if isinstance(column, str) else column
    return F.concat(column.cast("string"), F.lit("Z")).cast("timestamp")


def zone_free(column: Column) -> Column:
    """Back from absolute time to zone-free UTC."""
    seconds = F.unix_micros(column).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(20,0)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def table_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A Parquet table, a folder of files or one file, as a stream with its own schema."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    if is_folder(spark, path):
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def stream_request_metrics(log: DataFrame, minutes: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """`request_metrics` over a stream; a window is emitted once the watermark passes it."""
    return (
        log.withColumn("event_time", event_time("ts"))
        .withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", f"{int(minutes)} minutes").alias("w"))
        .agg(*request_aggregates(minutes))
        .select(
            zone_free(F.col("w.start")).alias("bucket_start"),
            "requests_per_minute",
            "error_rate",
            "avg_response_time",
        )
    )


def stream_new_addresses(found: DataFrame, time: str = "discovered_at", watermark: str = "1 day") -> DataFrame:
    """First sighting of each address; repeats within the watermark delay are dropped."""
    return (
        found.withColumn("event_time", event_time(time))
        .withWatermark("event_time", watermark)
        .dropDuplicatesWithinWatermark(["address"])
        .select("address")
    )


def stream_job_state(events: DataFrame, seq: str = "seq") -> DataFrame:
    """The running fold of job events: one state row per job, for update mode."""
    return job_event_fold(events, seq)


def run_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over all available input into parquet files."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run in update mode; a batch writes its own directory, so a repeated batch changes nothing."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write_batch)
        .start()
    )


def latest_updates(spark: SparkSession, path: str, key: str = "job_id") -> DataFrame:
    """The newest written row per key, over all batches."""
    written = spark.read.parquet(path)
    keep = [c for c in written.columns if c not in (key, "batch")]
    newest = written.groupBy(key).agg(F.max_by(F.struct(*keep), "batch").alias("row"))
    return newest.select(key, "row.*")
