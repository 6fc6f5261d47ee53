"""Crawl jobs: due jobs, status events, retries, the priority queue and pacing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from sitelode.functions.layout import exact_running_sum, spread_small, top_per_group
from sitelode.functions.scalars import iso_text, row_id, seconds_between, ts, typed_id
from sitelode.operators.quality import fill_defaults
from sitelode.session import materialize

MIN_DELAY_MS, MAX_DELAY_MS = 1000, 5000
MAX_WAIT_POWER = 20


def _due(jobs: DataFrame, as_of: datetime | str) -> DataFrame:
    return jobs.filter((F.col("status") == "pending") & (F.col("scheduled_for") <= ts(as_of)))


def _job_order() -> list[Column]:
    return [F.desc_nulls_first("priority"), F.asc("created_at"), F.asc("job_id")]


def pending_jobs(jobs: DataFrame, as_of: datetime | str, limit: int = 10) -> DataFrame:
    """Pending jobs whose time has come, highest priority first, then oldest."""
    return _due(jobs, as_of).orderBy(*_job_order()).limit(limit)


def pending_jobs_per_site(jobs: DataFrame, as_of: datetime | str, per_site: int) -> DataFrame:
    """The first `per_site` due jobs of every site, in the order of `pending_jobs`."""
    return top_per_group(_due(jobs, as_of), ["site_id"], _job_order(), per_site)


def create_crawl_jobs(requests: DataFrame, as_of: datetime | str, key_type: str = "string") -> DataFrame:
    """New job rows from (site_id, url[, priority, max_depth, metadata]), due at once.

    Give a `job_id` or it is derived from site, URL and time of creation, in the key type of the job table.
    `site_id` keeps its type.
    """
    rows = requests
    if "job_id" not in rows.columns:
        rows = rows.withColumn("job_id", typed_id(key_type, "site_id", "url", ts(as_of)))
    metadata = F.col("metadata") if "metadata" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumns({"metadata": F.coalesce(metadata, F.lit("{}")), "scheduled_for": ts(as_of)})
    return fill_defaults(rows, "crawl_jobs", as_of, add_missing=True)


def job_event_fold(events: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per job: what its status events, in `seq` order, leave behind.

    All values are maxima by sequence, so the fold is computed before the shuffle
    and a batch or a stream of events gives the same rows.
    """
    order, status = F.col(seq), F.col("status")
    ended = status.isin("completed", "failed")
    has_error = ended & F.col("error_message").isNotNull() & (F.col("error_message") != "")
    has_links = ended & F.col("discovered_links").isNotNull()
    return spread_small(events, "job_id").groupBy("job_id").agg(
        F.max_by("status", order).alias("new_status"),
        F.max_by("ts", F.when(status == "running", order)).alias("new_started_at"),
        F.max_by("ts", F.when(ended, order)).alias("new_completed_at"),
        F.max_by("error_message", F.when(has_error, order)).alias("new_error_message"),
        F.max_by("discovered_links", F.when(has_links, order)).alias("new_discovered_links"),
    )


EVENT_FIELDS = ("status", "started_at", "completed_at", "error_message", "discovered_links")


def job_status_update(jobs: DataFrame, events: DataFrame, seq: str = "seq") -> DataFrame:
    """Apply status events to the jobs; events of unknown jobs change nothing."""
    return apply_job_fold(jobs, job_event_fold(events, seq))


def apply_job_fold(jobs: DataFrame, fold: DataFrame) -> DataFrame:
    joined = jobs.join(fold, "job_id", "left")
    columns = []
    for name in [*jobs.columns, *[f for f in EVENT_FIELDS if f not in jobs.columns]]:
        if name in EVENT_FIELDS and name in jobs.columns:
            columns.append(F.coalesce(f"new_{name}", name).alias(name))
        elif name in EVENT_FIELDS:
            columns.append(F.col(f"new_{name}").alias(name))
        else:
            columns.append(F.col(name))
    return joined.select(*columns)


def retry_plan(jobs: DataFrame, as_of: datetime | str) -> DataFrame:
    """Failed jobs: those with retries left become `retry`, delayed 2^retry_count minutes.

    The longest wait is 2^MAX_WAIT_POWER minutes, about two years.
    """
    left = F.col("retry_count") < F.col("max_retries")
    power = F.least(F.col("retry_count"), F.lit(MAX_WAIT_POWER))
    wait = F.make_dt_interval(mins=F.pow(F.lit(2), power).cast("int"))
    return jobs.filter(F.col("status") == "failed").withColumns(
        {
            "status": F.when(left, "retry").otherwise(F.col("status")),
            "scheduled_for": F.when(left, ts(as_of) + wait).otherwise(F.col("scheduled_for")),
            "retry_count": F.when(left, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
        }
    )


def job_duration(jobs: DataFrame) -> DataFrame:
    """Add `duration_s` (start to end) and `wait_s` (creation to start) in whole seconds."""
    return jobs.withColumns(
        {
            "duration_s": seconds_between("started_at", "completed_at"),
            "wait_s": seconds_between("created_at", "started_at"),
        }
    )


def queue_push(jobs: DataFrame, as_of: datetime | str, batch: str, unique_key: str) -> DataFrame:
    """Queue entries for a batch of jobs: an id, a priority (default 0) and an ISO time.

    Ids come from the batch name and the job's own unique key, so a task that is
    run again pushes the same entries.
    """
    priority = F.coalesce("priority", F.lit(0)) if "priority" in jobs.columns else F.lit(0)
    return jobs.withColumns(
        {
            "id": row_id(F.lit(batch), unique_key),
            "priority": priority,
            "timestamp": iso_text(ts(as_of)),
        }
    )


def queue_pop(queue: DataFrame, n: int = 1, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The next `n` entries, lowest priority number first, and the queue without them.

    Equal priorities are taken in the string order of the id. The popped entries
    are written once, so both results speak of the same ones; an entry without id can be popped, too.
    """
    taken = materialize(queue.orderBy(F.asc("priority"), F.col(key).cast("string").asc()).limit(n), "popped")
    gone = taken.select(F.col(key).alias("_popped"))
    return taken, queue.join(gone, F.col(key).eqNullSafe(F.col("_popped")), "left_anti")


def queue_length(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count("*").alias("queue_length"))


def delay_ms(job_id: Column, low: int = MIN_DELAY_MS, high: int = MAX_DELAY_MS) -> Column:
    """Repeatable pause of a job in [low, high] milliseconds."""
    number = F.conv(F.substring(F.md5(job_id.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.lit(low) + F.pmod(number, F.lit(high - low + 1))


def politeness_schedule(
    jobs: DataFrame,
    host: str = "host",
    low: int = MIN_DELAY_MS,
    high: int = MAX_DELAY_MS,
    parts: int | None = None,
) -> DataFrame:
    """Start offset of each job in its host's own queue: running sum of the pauses.

    Order: priority descending, then job id, of any sortable type. `parts` sets the number of
    ranges the rows are cut into (default: the shuffle partitions).
    """
    timed = jobs.withColumn("delay_ms", delay_ms(F.col("job_id"), low, high))
    order = [F.desc_nulls_first("priority"), F.asc("job_id")]
    return exact_running_sum(timed, [host], order, "delay_ms", "start_ms", parts)
