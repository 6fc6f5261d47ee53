from datetime import datetime, timedelta

from pyspark.sql import Window, functions as F

from sitelode.operators import metrics

NOW = datetime(2024, 5, 2, 12, 0, 0)
SECOND = timedelta(seconds=1)


def test_mirror_groups_canonical_and_nulls(spark):
    frame = spark.createDataFrame(
        [
            ("b", "h", "en", NOW), ("a", "h", "en", NOW), ("c", "h", "en", None),
            ("d", "h", None, NOW), ("e", "h", None, NOW), ("f", None, "en", NOW), ("g", "solo", "en", NOW),
        ],
        "address string, title_hash string, language string, first_seen timestamp_ntz",
    )
    row, = metrics.mirror_groups(frame).collect()
    assert (row.title_hash, row.language, row.n_sites, row.canonical_address, row.first_seen) == ("h", "en", 3, "a", NOW)
    assert {r.address for r in metrics.mirror_members(frame).collect()} == {"a", "b", "c"}


def test_rollup_tells_null_from_subtotal(spark):
    frame = spark.createDataFrame([("active", None, "low"), ("active", "forum", "low")], "status string, category string, risk_level string")
    rows = {(r.status, r.category, r.risk_level, r.grouping_id): r.n_sites for r in metrics.status_rollup(frame).collect()}
    assert rows[("active", None, "low", 0)] == 1 and rows[("active", None, None, 1)] == 1
    assert rows[("active", None, None, 3)] == 2 and rows[(None, None, None, 7)] == 2


def test_catalog_counts_of_empty_tables(spark):
    sites = spark.createDataFrame([], "site_id int, category string")
    assert metrics.catalog_counts(sites, sites).first()[:] == (0, 0, 0)


def test_latest_rows_and_flags(spark):
    frame = spark.createDataFrame(
        [(1, 1, "block", NOW), (2, 1, "allow", NOW), (3, 2, "quarantine", NOW), (4, 2, "allow", NOW - SECOND), (5, 3, "block", NOW)],
        "id int, site_id int, action_taken string, checked_at timestamp_ntz",
    )
    got = {r.site_id: (r.id, r.is_illegal, r.requires_review) for r in metrics.latest_safety(frame).collect()}
    assert got == {1: (2, False, False), 2: (3, False, True), 3: (5, True, False)}


def changes(frame, **options):
    return {r.site_id: (r.n_observations, r.n_changes, r.last_changed) for r in metrics.change_detect(frame, **options).collect()}


def test_change_detect_small(spark):
    frame = spark.createDataFrame(
        [(1, 1, "a", NOW), (2, 1, "a", NOW + SECOND), (3, 1, None, NOW + 2 * SECOND), (4, 1, "a", NOW + 3 * SECOND),
         (5, 2, "a", NOW), (6, 2, "b", NOW), (7, 2, "a", NOW + SECOND)],
        "id int, site_id int, raw_content_hash string, discovered_at timestamp_ntz",
    )
    assert changes(frame) == {1: (3, 0, None), 2: (3, 2, NOW + SECOND)}


def test_change_detect_with_hot_sites_equals_plain_window(spark):
    frame = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("site_id"),
        (F.col("id") * 7919 % 5).cast("string").alias("raw_content_hash"),
        (F.lit(NOW).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 104729 % 9000)).alias("discovered_at"),
    )
    # a third of all rows in one site, part of them at one moment, with and without fractions
    moment = F.col("discovered_at") + F.make_dt_interval(secs=(F.col("id") % 7 / 7).cast("decimal(8,6)"))
    moved_to = F.when(F.col("id") % 12 == 0, F.lit(NOW).cast("timestamp_ntz")).otherwise(moment)
    frame = frame.withColumn("discovered_at", moved_to)
    before = F.lag("raw_content_hash").over(Window.partitionBy("site_id").orderBy("discovered_at", "id"))
    moved = F.col("before") != F.col("raw_content_hash")
    wanted = frame.withColumn("before", before).groupBy("site_id").agg(
        F.count("*"), F.count_if(moved), F.max(F.when(moved, F.col("discovered_at")))
    )
    expected = {r[0]: tuple(r[1:]) for r in wanted.collect()}
    assert changes(frame, parts=7) == expected and changes(frame) == expected
    texts = frame.withColumn("id", F.lpad(F.col("id").cast("string"), 6, "0"))
    assert changes(texts, parts=7) == expected


def test_resource_state_bounds(spark):
    resources = spark.createDataFrame([(i, i == 6) for i in range(1, 8)], "resource_id int, marked_dead boolean")
    requests = [(1, NOW - 600 * SECOND), (2, NOW - 601 * SECOND)]
    requests += [(3, NOW - SECOND)] * 100 + [(4, NOW - SECOND)] * 101 + [(5, NOW - 700 * SECOND)] * 101 + [(6, NOW)]
    log = spark.createDataFrame(requests, "resource_id int, ts timestamp_ntz")
    states = metrics.resource_state(resources, log, NOW)
    got = {r.resource_id: (r.state, r.is_healthy) for r in states.collect()}
    assert got == {
        1: ("active", True),  # exactly 600 s old
        2: ("dead", False),
        3: ("active", True),  # exactly 100 requests
        4: ("degraded", False),
        5: ("dead", False),  # dead is decided before degraded
        6: ("dead", False),  # marked
        7: ("fresh", True),
    }
    assert metrics.resource_stats(states).first()[:] == (7, 4, 3, 6)
    assert metrics.resource_stats(states, NOW - SECOND).first().sessions_cached == 3
    # the age bound of health is a bound of its own
    longer = metrics.resource_state(resources, log, NOW, lifetime_s=1000)
    assert {r.resource_id: (r.state, r.is_healthy) for r in longer.filter("resource_id = 2").collect()} == {2: ("active", False)}


def test_request_metrics_and_methods(spark):
    log = spark.createDataFrame(
        [(NOW, True, 1.0), (NOW + 30 * SECOND, False, 3.0), (NOW + 60 * SECOND, False, None)],
        "ts timestamp_ntz, is_error boolean, response_time double",
    )
    rows = [tuple(r) for r in metrics.request_metrics(log, 1).orderBy("bucket_start").collect()]
    assert rows == [(NOW, 2.0, 0.5, 2.0), (NOW + 60 * SECOND, 1.0, 0.0, None)]
    found = spark.createDataFrame([("seed", 1, 0.5), ("seed", 1, 0.7), ("api", 2, None)], "discovery_method string, site_id int, confidence double")
    for approximate in (False, True):
        got = {r.discovery_method: (r.n_results, r.n_sites) for r in metrics.discovery_by_method(found, approximate).collect()}
        assert got == {"seed": (2, 1), "api": (1, 1)}


def test_audit_and_tags(spark):
    logs = spark.createDataFrame(
        [("safety", "scan", "success", NOW), ("safety", "scan", "failure", NOW + SECOND), ("crawl", "get", "success", NOW)],
        "component string, action string, status string, created_at timestamp_ntz",
    )
    rows = {(r.component, r.action): (r.success, r.failure, r.warning) for r in metrics.audit_rollup(logs).collect()}
    assert rows == {("safety", "scan"): (1, 1, 0), ("crawl", "get"): (1, 0, 0)}
    assert metrics.audit_filter(logs, since=NOW, until=NOW + SECOND, status="success").count() == 2
    assert metrics.audit_filter(logs, "safety", "scan").count() == 2
    tags = spark.createDataFrame([(["a", "b"],), (["a"],), (None,), ([],)], "tags array<string>")
    assert {r.tag: r.n for r in metrics.tag_counts(tags).collect()} == {"a": 2, "b": 1}
