"""Job state as a stream: one fold per job, many to a key of the state, ended by timers, applied batch by batch to the job table."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sitelode.operators.jobs import EVENT_FIELDS, apply_job_fold
from sitelode.sources.catalog_io import read_current, write_atomic

ENDED = ("completed", "failed")
#: How long the state of a finished job is kept for events that come out of order.
KEEP_SECONDS = 86_400
#: Keys that the state is dealt to. A call of keyed state costs milliseconds, so one serves many jobs; a prime, so that ids with a
#: common divisor are spread, too. A checkpoint keeps the number it was started with.
STATE_KEYS = 4_093
#: Events that a task packs by state key at a time.
PACKED = 1 << 16
#: What the stream needs of its session: the state store that keyed state lives in, and no batches without data, which a stream
#: with timers would otherwise make for ever. Due timers fire with the next data.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _rank(value):
    """A sequence value in Python's order as Spark sorts it: null first, structs by their fields."""
    if isinstance(value, dict):  # the form a struct inside a row comes in
        value = tuple(value.values())
    if isinstance(value, tuple):
        return tuple(_rank(v) for v in value)
    return (value is not None, value)


def _ranks(column: pa.Array) -> list:
    """`_rank` of every value, structs taken by columns."""
    if pa.types.is_struct(column.type) and column.type.num_fields:
        return list(zip(*map(_ranks, column.flatten())))
    return [_rank(v) for v in column.to_pylist()]


def _fold_event(fold: tuple[list, list], status, ts, error_message, discovered_links, seq) -> None:
    """Put one event into a fold, the values and sequence values of EVENT_FIELDS."""
    values, seqs = fold
    if seqs[0] is None or seq >= seqs[0]:
        values[0], seqs[0] = status, seq
    if status == "running" and (seqs[1] is None or seq >= seqs[1]):
        values[1], seqs[1] = ts, seq
    if status not in ENDED:
        return
    if seqs[2] is None or seq >= seqs[2]:
        values[2], seqs[2] = ts, seq
    if error_message and (seqs[3] is None or seq >= seqs[3]):
        values[3], seqs[3] = error_message, seq
    if discovered_links is not None and (seqs[4] is None or seq >= seqs[4]):
        values[4], seqs[4] = discovered_links, seq


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(state key, list of its events) from events and their `_key`, PACKED events at a time."""
    def block() -> pa.RecordBatch:
        lists = pa.array([pickle.dumps(events) for events in lists_of.values()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(lists_of), pa.int64()), lists], names=["job_id", "events"])

    lists_of, n = defaultdict(list), 0
    for batch in batches:
        keys, *events = (batch.column(name).to_pylist() for name in ("_key", "job_id", "status", "ts", "error_message", "discovered_links"))
        for key, event in zip(keys, zip(*events, _ranks(batch.column("seq")))):
            lists_of[key].append(event)
        n += batch.num_rows
        if n >= PACKED:
            yield block()
            lists_of, n = defaultdict(list), 0
    if n:
        yield block()


class JobFold(StatefulProcessor):
    """What the events of the jobs of one state key leave behind, as `job_event_fold` defines it, one row per job and batch.

    Each field keeps the sequence value it was taken from, so events may come in any order. A batch in which jobs end sets a timer;
    when it fires, those of them that have not been touched since leave the state, and the state of a key without jobs goes.
    """

    def __init__(self, keep_seconds: int):
        self.keep_ms = keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", T.StructType([T.StructField("jobs", T.BinaryType())]))

    def _held(self) -> dict:
        """The jobs of the key with their folds and the times at which they leave, null for unfinished ones."""
        held = self.state.get()
        return pickle.loads(held[0]) if held else {}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        jobs, touched = self._held(), {}
        for row in rows:
            for job, *event in pickle.loads(row.events):
                if job not in touched:
                    touched[job] = jobs[job][0] if job in jobs else ([None] * len(EVENT_FIELDS), [None] * len(EVENT_FIELDS))
                _fold_event(touched[job], *event)
        until = timerValues.getCurrentProcessingTimeInMs() + self.keep_ms
        ended = {job for job, (values, _) in touched.items() if values[0] in ENDED}
        if ended:
            self.handle.registerTimer(until)
        jobs.update((job, (fold, until if job in ended else None)) for job, fold in touched.items())
        self.state.update((pickle.dumps(jobs),))
        out = Row("job_id", *(f"new_{field}" for field in EVENT_FIELDS))
        return (out(job, *values) for job, (values, _) in touched.items())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # a later event has set a later time, or none
        due = expiredTimerInfo.getExpiryTimeInMs()
        jobs = self._held()
        left = {job: (fold, until) for job, (fold, until) in jobs.items() if until is None or until > due}
        if not left:
            self.state.clear()
        elif len(left) < len(jobs):
            self.state.update((pickle.dumps(left),))
        return iter(())

    def close(self) -> None:
        pass


def _state_key(events: DataFrame) -> Column:
    """The key that holds the state of a job: an integer id modulo STATE_KEYS, any other id by its hash."""
    whole = isinstance(events.schema["job_id"].dataType, T.IntegralType)
    return F.pmod(F.col("job_id").cast("bigint") if whole else F.xxhash64("job_id"), F.lit(STATE_KEYS)).cast("bigint")


def stream_job_state(events: DataFrame, keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """The running fold of job events: per batch one row (job_id, new_<field> ...) for every job it touches.

    `events` has (job_id, seq, ts, status, error_message, discovered_links). The state holds every unfinished job and every job that
    ended in the last `keep_seconds` of running time. Within that time events count by their sequence, whatever order
    they come in; an event after it starts a fold of its own, whose fields the job table takes over while it keeps all
    others. A call of the state serves all jobs of one of STATE_KEYS keys, which is the `job_id` that the state names, and events
    come to it packed by key. Start it with STREAM_SETTINGS, as `run_job_state` does.
    """
    kinds = {f.name: f.dataType for f in events.schema.fields} | {"started_at": events.schema["ts"].dataType, "completed_at": events.schema["ts"].dataType}
    out = T.StructType([events.schema["job_id"], *[T.StructField(f"new_{name}", kinds[name]) for name in EVENT_FIELDS]])
    rows = events.select(_state_key(events).alias("_key"), "job_id", "status", "ts", "error_message", "discovered_links", "seq")
    # dealt by key first: a batch may be one file, and the events of a key then fill few packs
    packs = rows.repartition("_key").mapInArrow(_packed, "job_id bigint, events binary")
    return packs.groupBy("job_id").transformWithState(JobFold(keep_seconds), out, "Update", "ProcessingTime")


def run_job_state(events: DataFrame, root: str, checkpoint: str, keep_seconds: int = KEEP_SECONDS) -> StreamingQuery:
    """Apply all available events to the `crawl_jobs` of the catalog at `root`, one new version of the table per batch.

    A batch holds the whole fold of the jobs it touches, so one that is repeated after a failure leaves the same table.
    Events of unknown jobs change nothing. Readers see a whole version or the one before; see `write_atomic`.
    """
    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_atomic(spark, root, {"crawl_jobs": apply_job_fold(read_current(spark, root, "crawl_jobs"), batch)})

    conf = events.sparkSession.conf
    before = {name: conf.get(name, None) for name in STREAM_SETTINGS}
    for name, value in STREAM_SETTINGS.items():
        conf.set(name, value)
    try:  # a query keeps the settings it was started with
        return _started(stream_job_state(events, keep_seconds), apply_batch, checkpoint)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def _started(folds: DataFrame, apply_batch, checkpoint: str) -> StreamingQuery:
    return (
        folds.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(apply_batch)
        .start()
    )
