import random
from datetime import datetime, timedelta

from pyspark.sql import Window, functions as F

from sitelode.functions.scalars import iso_text, seconds_between
from sitelode.operators import jobs

NOW = datetime(2024, 5, 2, 12, 0, 0)
MINUTE = timedelta(minutes=1)
JOB = "job_id bigint, site_id bigint, priority int, status string, created_at timestamp_ntz, scheduled_for timestamp_ntz"


def test_pending_jobs_order_and_due_time(spark):
    frame = spark.createDataFrame(
        [
            (1, 1, 1, "pending", NOW, NOW),  # due exactly now
            (2, 1, 5, "pending", NOW, None),  # never due
            (3, 1, 5, "pending", NOW, NOW + MINUTE),
            (4, 1, 3, "pending", NOW, NOW - MINUTE),
            (5, 2, 3, "pending", NOW - MINUTE, NOW - MINUTE),
            (6, 2, None, "pending", NOW, NOW - MINUTE),  # null priority sorts first
            (7, 2, 9, "running", NOW, NOW - MINUTE),
        ],
        JOB,
    )
    assert [r.job_id for r in jobs.pending_jobs(frame, NOW).collect()] == [6, 5, 4, 1]
    assert [r.job_id for r in jobs.pending_jobs(frame, NOW, limit=2).collect()] == [6, 5]
    per_site = {(r.site_id, r.rank): r.job_id for r in jobs.pending_jobs_per_site(frame, NOW, 1).collect()}
    assert per_site == {(1, 1): 4, (2, 1): 6}


def test_new_jobs_are_due_at_once(spark):
    asked = spark.createDataFrame([("s1", "http://x/", 4, None)], "site_id string, url string, priority int, metadata string")
    row = jobs.create_crawl_jobs(asked, NOW).first()
    assert (row.priority, row.max_depth, row.status, row.metadata, row.scheduled_for) == (4, 1, "pending", "{}", NOW)
    assert row.job_id == jobs.create_crawl_jobs(asked, NOW).first().job_id


def apply_one(job, event):
    """The rule for a single event, stated row by row."""
    job["status"] = event["status"]
    if event["status"] == "running":
        job["started_at"] = event["ts"]
    elif event["status"] in ("completed", "failed"):
        job["completed_at"] = event["ts"]
        if event["error_message"]:
            job["error_message"] = event["error_message"]
        if event["discovered_links"] is not None:
            job["discovered_links"] = event["discovered_links"]


def test_status_fold_equals_one_by_one(spark):
    rng = random.Random(5)
    start = {"status": "pending", "started_at": None, "completed_at": None, "error_message": "old", "discovered_links": 0}
    state = {i: dict(start) for i in range(20)}
    events = []
    for seq in range(150):
        event = {
            "job_id": rng.randrange(25), "seq": seq, "ts": NOW + seq * MINUTE,
            "status": rng.choice(["pending", "running", "completed", "failed", "retry"]),
            "error_message": rng.choice([None, "", f"e{seq}"]), "discovered_links": rng.choice([None, 0, seq]),
        }
        events.append(event)
        if event["job_id"] in state:
            apply_one(state[event["job_id"]], event)
    columns = "status string, started_at timestamp_ntz, completed_at timestamp_ntz, error_message string, discovered_links int"
    frame = spark.createDataFrame([(i, *start.values()) for i in range(20)], f"job_id int, {columns}")
    rng.shuffle(events)
    log = spark.createDataFrame(
        [tuple(e.values()) for e in events],
        "job_id int, seq int, ts timestamp_ntz, status string, error_message string, discovered_links int",
    )
    got = {r.job_id: {k: r[k] for k in start} for r in jobs.job_status_update(frame, log).collect()}
    assert got == state  # jobs 20..24 are unknown and add no row


def test_retry_plan(spark):
    frame = spark.createDataFrame(
        [(1, "failed", 0, 3, None), (2, "failed", 2, 3, None), (3, "failed", 3, 3, NOW), (4, "running", 0, 3, NOW)],
        "job_id int, status string, retry_count int, max_retries int, scheduled_for timestamp_ntz",
    )
    got = {r.job_id: (r.status, r.retry_count, r.scheduled_for) for r in jobs.retry_plan(frame, NOW).collect()}
    assert got == {1: ("retry", 1, NOW + MINUTE), 2: ("retry", 3, NOW + 4 * MINUTE), 3: ("failed", 3, NOW)}


def test_queue_order_is_lowest_score_then_text(spark):
    frame = spark.createDataFrame([("10", 1), ("9", 1), ("b", 0), ("c", -1)], "id string, priority int")
    popped, rest = jobs.queue_pop(frame, 3)
    assert [r.id for r in popped.collect()] == ["c", "b", "10"]
    assert [r.id for r in rest.collect()] == ["9"]
    assert popped.unionByName(rest).exceptAll(frame).count() == 0 and jobs.queue_length(rest).first()[0] == 1
    empty, none = jobs.queue_pop(frame.filter("false"), 1)
    assert empty.count() == 0 and none.count() == 0


def test_queue_push_ids_and_time(spark):
    frame = spark.createDataFrame([("j1", "u1"), ("j2", "u2")], "key string, url string")
    pushed = jobs.queue_push(frame, NOW, "b7", "key").collect()
    assert len({r.id for r in pushed}) == 2 and {r.priority for r in pushed} == {0}
    assert {r.timestamp for r in pushed} == {"2024-05-02T12:00:00"}


def test_politeness_schedule_with_a_hot_host(spark):
    """Cutting a hot host into slices gives the plain running sum, for number and text ids."""
    base = spark.range(400).select(
        (F.col("id") * 37 * 9973).alias("job_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") % 40).cast("string"))).alias("host"),
        F.when(F.col("id") % 11 != 0, (F.col("id") % 4).cast("int")).alias("priority"),
    )
    for frame in (base, base.withColumn("job_id", F.sha2(F.col("job_id").cast("string"), 256))):
        order = Window.partitionBy("host").orderBy(F.desc_nulls_first("priority"), "job_id").rowsBetween(Window.unboundedPreceding, 0)
        wanted = frame.withColumn("delay_ms", jobs.delay_ms(F.col("job_id"))).withColumn("start_ms", F.sum("delay_ms").over(order))
        got = jobs.politeness_schedule(frame, parts=7)
        columns = ["job_id", "host", "delay_ms", "start_ms"]
        assert {tuple(r) for r in got.select(columns).collect()} == {tuple(r) for r in wanted.select(columns).collect()}
        assert got.agg(F.min("delay_ms") >= 1000, F.max("delay_ms") <= 5000).first()[:] == (True, True)


def test_durations_do_not_depend_on_the_session_time_zone(spark):
    rows = [(datetime(2024, 3, 10, 1, 30), datetime(2024, 3, 10, 3, 30, 0, 500000), datetime(2024, 3, 10, 2, 30))]
    frame = spark.createDataFrame(rows, "created_at timestamp_ntz, completed_at timestamp_ntz, started_at timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            row = jobs.job_duration(frame).first()
            assert (row.duration_s, row.wait_s) == (3600, 3600)
            assert frame.select(iso_text("started_at"), iso_text("completed_at")).first()[:] == (
                "2024-03-10T02:30:00", "2024-03-10T03:30:00.500000",
            )
            assert frame.select(seconds_between("completed_at", "created_at")).first()[0] == -7200
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
