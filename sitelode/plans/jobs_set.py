"""Queries over crawl jobs, the queue and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.functions.scalars import ts
from sitelode.operators import content, jobs
from sitelode.plans.registry import query
from sitelode.plans.views import AS_OF_JOBS, Fixture
from sitelode.session import scratch_path
from sitelode.sources import catalog_io
from sitelode.streaming import job_state, streams

JOBS = f"TIMESTAMP '{AS_OF_JOBS}'"

FOLD = """
SELECT job_id, arg_max(status, seq) AS status,
    arg_max(ts, seq) FILTER (WHERE status = 'running') AS started_at,
    arg_max(ts, seq) FILTER (WHERE status IN ('completed', 'failed')) AS completed_at,
    arg_max(error_message, seq) FILTER (WHERE status IN ('completed', 'failed') AND error_message <> '') AS error_message,
    arg_max(discovered_links, seq) FILTER (WHERE status IN ('completed', 'failed') AND discovered_links IS NOT NULL) AS discovered_links
  FROM job_events GROUP BY job_id"""


@query(
    "pending_jobs",
    f"""
SELECT job_id, site_id, priority, created_at FROM crawl_jobs
WHERE status = 'pending' AND scheduled_for <= {JOBS}
ORDER BY priority DESC NULLS FIRST, created_at, job_id LIMIT 10""",
)
def pending_jobs(fx: Fixture):
    return jobs.pending_jobs(fx.crawl_jobs, AS_OF_JOBS).select("job_id", "site_id", "priority", "created_at")


@query(
    "pending_jobs_per_site",
    f"""
SELECT job_id, site_id, rank FROM (
  SELECT job_id, site_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY priority DESC NULLS FIRST, created_at, job_id) AS INT) AS rank
  FROM crawl_jobs WHERE status = 'pending' AND scheduled_for <= {JOBS}) r
WHERE rank <= 2""",
)
def pending_jobs_per_site(fx: Fixture):
    return jobs.pending_jobs_per_site(fx.crawl_jobs, AS_OF_JOBS, 2).select("job_id", "site_id", "rank")


@query(
    "create_crawl_jobs",
    f"""
SELECT sha256(concat_ws(chr(31), CAST(site_id AS VARCHAR), concat('http://', address, '/'), '{AS_OF_JOBS}')) AS job_id,
  site_id, concat('http://', address, '/') AS url, 0 AS priority, 1 AS max_depth, 'pending' AS status,
  0 AS retry_count, 3 AS max_retries, 0 AS discovered_links, {JOBS} AS created_at, {JOBS} AS scheduled_for, '{{}}' AS metadata
FROM sites""",
)
def create_crawl_jobs(fx: Fixture):
    requests = fx.sites.select(
        "site_id", F.concat(F.lit("http://"), "address", F.lit("/")).alias("url")
    )
    return jobs.create_crawl_jobs(requests, AS_OF_JOBS).select(
        "job_id", "site_id", "url", "priority", "max_depth", "status", "retry_count", "max_retries",
        "discovered_links", "created_at", "scheduled_for", "metadata",
    )


@query(
    "job_status_update",
    f"""
WITH f AS ({FOLD})
SELECT j.job_id, coalesce(f.status, j.status) AS status, f.started_at, f.completed_at, f.error_message, f.discovered_links
FROM crawl_jobs j LEFT JOIN f ON f.job_id = j.job_id""",
)
def job_status_update(fx: Fixture):
    return jobs.job_status_update(fx.crawl_jobs, fx.job_events).select(
        "job_id", "status", "started_at", "completed_at", "error_message", "discovered_links"
    )


@query(
    "retry_plan",
    f"""
SELECT job_id, CASE WHEN retry_count < max_retries THEN 'retry' ELSE status END AS status,
  CASE WHEN retry_count < max_retries THEN retry_count + 1 ELSE retry_count END AS retry_count,
  CASE WHEN retry_count < max_retries
    THEN {JOBS} + CAST(CASE retry_count WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS BIGINT) * INTERVAL 1 MINUTE
    ELSE scheduled_for END AS scheduled_for
FROM crawl_jobs WHERE status = 'failed'""",
)
def retry_plan(fx: Fixture):
    return jobs.retry_plan(fx.crawl_jobs, AS_OF_JOBS).select("job_id", "status", "retry_count", "scheduled_for")


@query(
    "job_duration",
    f"""
WITH f AS ({FOLD})
SELECT j.job_id, date_diff('second', f.started_at, f.completed_at) AS duration_s, date_diff('second', j.created_at, f.started_at) AS wait_s
FROM crawl_jobs j LEFT JOIN f ON f.job_id = j.job_id""",
)
def job_duration(fx: Fixture):
    updated = jobs.job_status_update(fx.crawl_jobs, fx.job_events)
    return jobs.job_duration(updated).select("job_id", "duration_s", "wait_s")


@query(
    "queue_push",
    f"""
SELECT sha256(concat_ws(chr(31), 'batch-1', CAST(job_id AS VARCHAR))) AS id, priority, '1999-01-01T00:00:00' AS "timestamp", url
FROM crawl_jobs WHERE status = 'pending'""",
)
def queue_push(fx: Fixture):
    pending = fx.crawl_jobs.filter("status = 'pending'")
    return jobs.queue_push(pending, AS_OF_JOBS, "batch-1", "job_id").select("id", "priority", "timestamp", "url")


@query(
    "queue_pop",
    """
SELECT job_id, priority, row_number() OVER (ORDER BY priority, CAST(job_id AS VARCHAR)) <= 250 AS popped
FROM crawl_jobs WHERE status = 'pending'""",
)
def queue_pop(fx: Fixture):
    popped, rest = jobs.queue_pop(fx.crawl_jobs.filter("status = 'pending'"), 250, "job_id")
    both = popped.withColumn("popped", F.lit(True)).unionByName(rest.withColumn("popped", F.lit(False)))
    return both.select("job_id", "priority", "popped")


@query("queue_length", "SELECT count(*) AS queue_length FROM crawl_jobs WHERE status = 'pending'")
def queue_length(fx: Fixture):
    return jobs.queue_length(fx.crawl_jobs.filter("status = 'pending'"))


@query(
    "politeness_schedule",
    """
WITH d AS (
  SELECT job_id, priority, regexp_extract(url, '://([^/]+)', 1) AS host,
    1000 + CAST('0x' || substr(md5(CAST(job_id AS VARCHAR)), 1, 8) AS BIGINT) % 4001 AS delay_ms
  FROM crawl_jobs)
SELECT job_id, host, delay_ms,
  CAST(sum(delay_ms) OVER (PARTITION BY host ORDER BY priority DESC NULLS FIRST, job_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS start_ms
FROM d""",
)
def politeness_schedule(fx: Fixture):
    hosted = fx.crawl_jobs.select("job_id", "priority", content.host_of("url").alias("host"))
    return jobs.politeness_schedule(hosted).select("job_id", "host", "delay_ms", "start_ms")


@query(
    "stream_request_metrics",
    """
WITH b AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, count(*) / 60.0 AS rpm,
    avg(CASE WHEN is_error THEN 1 ELSE 0 END) AS er, avg(response_time) AS rt FROM request_log GROUP BY 1)
SELECT bucket_start, round(CAST(rpm AS DOUBLE), 6) AS requests_per_minute, round(er, 6) AS error_rate, round(rt, 6) AS avg_response_time
FROM b WHERE bucket_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM request_log)""",
)
def stream_request_metrics(fx: Fixture):
    log = streams.table_stream(fx.spark, f"{fx.folder}/events.parquet").select(
        "ts", (F.col("event_type") == "error").alias("is_error"), F.col("value").alias("response_time")
    )
    root = scratch_path(fx.spark, "metrics-stream")
    streams.run_append(streams.stream_request_metrics(log), f"{root}/rows", f"{root}/state").awaitTermination()
    rows = fx.spark.read.parquet(f"{root}/rows")
    return rows.select(
        "bucket_start", *[F.round(c, 6).alias(c) for c in ("requests_per_minute", "error_rate", "avg_response_time")]
    )


@query(
    "stream_job_state",
    FOLD,
)
def stream_job_state(fx: Fixture):
    lines = streams.table_stream(fx.spark, f"{fx.folder}/lineitem.parquet")
    events = Fixture(fx.spark, fx.folder, {"lineitem": lines}).job_events
    root = scratch_path(fx.spark, "job-stream")
    # a catalog whose jobs have not begun; each batch of events makes a new version of the job table
    kinds = {f.name: f.dataType for f in events.schema.fields} | {"started_at": events.schema["ts"].dataType, "completed_at": events.schema["ts"].dataType}
    idle = fx.crawl_jobs.select("job_id", *[F.lit(None).cast(kinds[f]).alias(f) for f in jobs.EVENT_FIELDS])
    catalog_io.write_atomic(fx.spark, f"{root}/catalog", {"crawl_jobs": idle})
    job_state.run_job_state(events, f"{root}/catalog", f"{root}/state").awaitTermination()
    applied = catalog_io.read_current(fx.spark, f"{root}/catalog", "crawl_jobs")
    return applied.filter("status IS NOT NULL").select("job_id", *jobs.EVENT_FIELDS)


@query("stream_new_addresses", "SELECT DISTINCT address FROM site_updates")
def stream_new_addresses(fx: Fixture):
    events = streams.table_stream(fx.spark, f"{fx.folder}/events.parquet")
    live = Fixture(fx.spark, fx.folder, {"events": events})
    found = live.site_updates.select("address", (ts("2024-01-01 00:00:00") + F.make_dt_interval(secs=F.col("seq"))).alias("discovered_at"))
    root = scratch_path(fx.spark, "address-stream")
    streams.run_append(streams.stream_new_addresses(found), f"{root}/rows", f"{root}/state").awaitTermination()
    return fx.spark.read.parquet(f"{root}/rows")
