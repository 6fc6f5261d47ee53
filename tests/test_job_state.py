"""Job state in a stream: order, end of state, application to the job table."""

import pickle
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitelode.operators import jobs
from sitelode.sources import catalog_io
from sitelode.streaming import job_state

NOW = datetime(2024, 5, 2, 12, 0, 0)
MINUTE = timedelta(minutes=1)
EVENT = "job_id int, seq int, ts timestamp_ntz, status string, error_message string, discovered_links int"
JOB = "job_id int, url string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, error_message string, discovered_links int"


class Events:
    """A folder of event files, read one file per batch in the order they were added."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, str(folder), 0

    def add(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), EVENT).coalesce(1).write.mode("append").parquet(self.folder)
        return self

    @property
    def stream(self):
        return self.spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(self.folder)

    @property
    def batch(self):
        return self.spark.read.schema(EVENT).parquet(self.folder)


@pytest.fixture
def catalog(spark, tmp_path):
    root = str(tmp_path / "catalog")
    rows = [(i, f"u{i}", "pending", None, None, None, None) for i in range(1, 6)]
    catalog_io.write_atomic(spark, root, {"crawl_jobs": spark.createDataFrame(rows, JOB)})
    return root


def table(spark, root):
    return {r.job_id: r for r in catalog_io.read_current(spark, root, "crawl_jobs").collect()}


def test_stream_equals_batch_in_any_order_and_repeats_are_harmless(spark, tmp_path, catalog):
    first = catalog_io.read_current(spark, catalog, "crawl_jobs")
    events = Events(spark, tmp_path / "in")
    events.add((1, 1, NOW, "running", None, None), (2, 2, NOW, "running", None, None), (9, 1, NOW, "running", None, None))
    events.add((1, 3, NOW + MINUTE, "failed", "", 0), (3, 4, NOW, "retry", "no", 5))
    events.add((1, 5, NOW + 2 * MINUTE, "completed", "warned", None), (2, 0, NOW - MINUTE, "failed", "late", 3), (1, 4, NOW, "running", "x", 8))
    state = str(tmp_path / "state")
    job_state.run_job_state(events.stream, catalog, state).awaitTermination()
    wanted = {r.job_id: tuple(r) for r in jobs.job_status_update(first, events.batch).collect()}
    assert {k: tuple(r) for k, r in table(spark, catalog).items()} == wanted
    assert wanted[2][2:5] == ("running", NOW, NOW - MINUTE) and 9 not in wanted
    # nothing new, and the whole fold applied once more, change nothing
    job_state.run_job_state(events.stream, catalog, state).awaitTermination()
    again = jobs.apply_job_fold(catalog_io.read_current(spark, catalog, "crawl_jobs"), jobs.job_event_fold(events.batch))
    assert {r.job_id: tuple(r) for r in again.collect()} == wanted


def rows_of_state(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_finished_jobs_leave_the_state_and_late_events_keep_the_end(spark, tmp_path, catalog):
    events, state = Events(spark, tmp_path / "in"), str(tmp_path / "state")
    events.add(*[(i, 1, NOW, "running", None, None) for i in range(1, 6)], *[(i, 2, NOW + MINUTE, "completed", None, i) for i in range(1, 5)])
    job_state.run_job_state(events.stream, catalog, state, keep_seconds=0).awaitTermination()
    # the next batch finds the timers due: only the job that runs keeps its state
    events.add((5, 2, NOW + MINUTE, "pending", None, None))
    query = job_state.run_job_state(events.stream, catalog, state, keep_seconds=0)
    query.awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "fold").load(state)
    assert {r.key.job_id for r in held.select("key").collect()} == {5}
    events.add((1, 3, NOW + 2 * MINUTE, "running", None, None))
    job_state.run_job_state(events.stream, catalog, state, keep_seconds=0).awaitTermination()
    row = table(spark, catalog)[1]
    assert (row.status, row.started_at, row.completed_at, row.discovered_links) == ("running", NOW + 2 * MINUTE, NOW + MINUTE, 1)


def test_state_stays_bounded_over_many_batches(spark, tmp_path, catalog):
    events, state, sizes = Events(spark, tmp_path / "in"), str(tmp_path / "state"), []
    for batch in range(4):
        events.add(*[(100 * batch + i, 1, NOW, "failed", "e", None) for i in range(20)])
        job_state.run_job_state(events.stream, catalog, state, keep_seconds=0).awaitTermination()
        sizes.append(spark.read.format("statestore").option("stateVarName", "fold").load(state).count())
    assert max(sizes) <= 20  # the jobs of one batch, not of all


def test_struct_sequences_with_nulls_sort_as_spark_sorts_them():
    ranks = [job_state._rank(v) for v in ((None, 1), (0, None), (0, 1), (1, None))]
    assert job_state._rank({"a": 0, "b": None}) == ranks[1]
    assert ranks == sorted(ranks) and job_state._rank(None) < job_state._rank(-5)


def test_state_serves_many_jobs_by_one_key_and_each_leaves_by_itself(spark, tmp_path, catalog):
    far = 5 + job_state.STATE_KEYS  # shares its key with job 5
    rows = [(i, "u", None, None, None, None, None) for i in (5, far, None)]
    catalog_io.write_atomic(spark, catalog, {"crawl_jobs": spark.createDataFrame(rows, JOB)})
    events, state = Events(spark, tmp_path / "in"), str(tmp_path / "state")
    events.add((5, 1, NOW, "running", None, None), (far, 2, NOW, "failed", "e", 1), (far, None, NOW - MINUTE, "completed", None, 2), (None, 1, NOW, "failed", "n", 3))
    job_state.run_job_state(events.stream, catalog, state).awaitTermination()

    def held():
        blobs = spark.read.format("statestore").option("stateVarName", "fold").load(state).collect()
        return [(r.key.job_id, set(pickle.loads(r.value.jobs))) for r in blobs if r.key.job_id is not None]

    assert held() == [(5, {5, far})]
    # job 5 runs on, the other is due at once
    events.add((5, 0, NOW - MINUTE, "completed", "old", None), (far, 3, NOW + MINUTE, "completed", None, None))
    job_state.run_job_state(events.stream, catalog, state, keep_seconds=0).awaitTermination()
    assert held() == [(5, {5})]
    got = table(spark, catalog)
    assert tuple(got[5])[2:] == ("running", NOW, NOW - MINUTE, "old", None)
    assert tuple(got[far])[2:] == ("completed", None, NOW + MINUTE, "e", 1) and got[None].status is None


def test_text_ids_are_dealt_to_few_keys(spark, tmp_path):
    root = str(tmp_path / "catalog")
    ids = [f"job-{i}" for i in range(job_state.STATE_KEYS)]
    text_job, text_event = JOB.replace("job_id int", "job_id string"), EVENT.replace("job_id int", "job_id string")
    catalog_io.write_atomic(spark, root, {"crawl_jobs": spark.createDataFrame([(i, "u", "pending", None, None, None, None) for i in ids], text_job)})
    events = spark.createDataFrame([(i, n, NOW + n * MINUTE, s, None, n) for i in ids for n, s in enumerate(("running", "completed"))], text_event)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(text_event).parquet(str(tmp_path / "in"))
    job_state.run_job_state(stream, root, str(tmp_path / "state")).awaitTermination()
    rows = catalog_io.read_current(spark, root, "crawl_jobs").collect()
    assert {r.job_id for r in rows} == set(ids) and {tuple(r)[2:] for r in rows} == {("completed", NOW, NOW + MINUTE, None, 1)}
    keys = spark.read.format("statestore").option("stateVarName", "fold").load(str(tmp_path / "state")).count()
    assert keys < 0.7 * len(ids)  # calls of the state grow to STATE_KEYS and no further
