"""Runs that write back: safety, hashes, risk, changes, metrics, audit; classifiers and ids by type."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitelode.functions.scalars import json_variant, variant_value
from sitelode.operators import bayes, quality
from sitelode.operators.catalog import with_site_values
from sitelode.operators.jobs import create_crawl_jobs
from sitelode.plans import runs
from sitelode.plans.discovery import append_discoveries, by_bayes, classify_run, discovery_run
from sitelode.schema import TABLES
from sitelode.sources.text_lists import pattern_parse

NOW = datetime(2024, 5, 2, 12, 0, 0)
DAY = timedelta(days=1)
PATTERNS = pattern_parse("# Category 1: Bad\n/forbidden/i\n# Category 2: Worse\n/very *forbidden/i\n")
SITE = "site_id bigint, address string, is_honeypot boolean, is_illegal boolean, requires_review boolean"


def address(letter):
    return letter * 56 + ".onion"


def sites(spark):
    rows = [(1, "a", False, False, False), (2, "b", None, True, False), (3, "c", True, False, None), (4, "d", False, False, True), (5, "e", False, False, False)]
    return spark.createDataFrame(rows, SITE)


def test_safety_run_writes_checks_and_flags(spark):
    contents = spark.createDataFrame(
        [(1, "VERY forbidden", None), (1, "fine", None), (1, "fine", None), (2, "fine", ["odd"]), (3, None, None), (4, "x" * 60, None), (9, "forbidden", None)],
        "site_id bigint, text string, risk_factors array<string>",
    )
    known = spark.createDataFrame([("e",), ("e",), ("zz",)], "address string")
    run = runs.safety_run(sites(spark), contents, PATTERNS, NOW, max_bytes=50, known_honeypots=known, filter_version="v9")
    checks = run.safety_checks
    assert checks.columns == TABLES["safety_checks"].names
    got = sorted((r.site_id, r.action_taken, tuple(r.flagged_categories), r.filter_version, r.checked_at) for r in checks.collect())
    assert got == [
        (1, "allow", (), "v9", NOW), (1, "block", ("Bad", "Worse"), "v9", NOW), (2, "review", (), "v9", NOW),
        (3, "review", (), "v9", NOW), (4, "quarantine", (), "v9", NOW),
    ]
    assert dict(checks.dtypes)["site_id"] == "bigint" and {r.is_safe for r in checks.filter("action_taken = 'allow'").collect()} == {True}
    flags = {r.site_id: (r.is_illegal, r.requires_review, r.is_honeypot) for r in run.sites.collect()}
    assert flags == {1: (True, False, False), 2: (True, True, None), 3: (False, True, True), 4: (False, True, False), 5: (False, False, True)}
    again = runs.safety_run(sites(spark), contents, PATTERNS, NOW, max_bytes=50, filter_version="v9").safety_checks
    assert {r.id for r in again.collect()} == {r.id for r in checks.collect()}
    nothing = runs.safety_run(sites(spark), contents.limit(0), PATTERNS, NOW)
    assert nothing.safety_checks.count() == 0 and nothing.sites.count() == 5


def test_values_written_back_keep_what_is_null(spark):
    values = spark.createDataFrame([(1, None, 0.7), (2, True, None), (77, True, 1.0)], "site_id bigint, is_illegal boolean, risk_score double")
    got = {r.site_id: (r.is_illegal, r.risk_score) for r in with_site_values(sites(spark), values).collect()}
    assert got == {1: (False, 0.7), 2: (True, 0.0), 3: (False, 0.0), 4: (False, 0.0), 5: (False, 0.0)}


def test_content_hashes_one_per_site_and_type(spark):
    contents = spark.createDataFrame(
        [(1, "Title", "some words", NOW), (1, "Newer", "other words", NOW + DAY), (2, None, "...", NOW), (3, "T", None, NOW), (4, None, None, NOW)],
        "site_id bigint, title string, text string, fetched_at timestamp_ntz",
    )
    rows = runs.content_hash_rows(contents, NOW)
    assert rows.columns == TABLES["content_hashes"].names
    assert quality.unique_check(rows, ["site_id", "hash_type"]).count() == 0
    got = {(r.site_id, r.hash_type): r for r in rows.collect()}
    assert got.keys() == {(1, "title"), (1, "document"), (1, "text_simhash"), (2, "document"), (3, "title")}
    assert got[1, "document"].content_size == 11 and got[1, "document"].created_at == NOW + DAY and got[1, "title"].mime_type is None
    assert len(got[1, "text_simhash"].hash_value) == 15 and got[1, "text_simhash"].algorithm == "simhash60-md5"
    old = rows.filter("site_id = 1").withColumns({"created_at": F.col("created_at") + F.make_dt_interval(days=F.lit(9)), "hash_value": F.lit("kept")})
    kept = runs.hash_run(old, contents, NOW)
    assert {r.hash_value for r in kept.filter("site_id = 1").collect()} == {"kept"} and kept.count() == 5


def test_risk_and_change_are_written_back(spark):
    frame = sites(spark).withColumns({"risk_score": F.lit(0.9), "last_changed": F.lit(NOW).cast("timestamp_ntz")})
    classes = spark.createDataFrame([(1, 1, 0.5, NOW), (2, 1, 1.0, NOW + DAY)], "id int, site_id bigint, confidence double, classified_at timestamp_ntz")
    checks = spark.createDataFrame(
        [(1, 3, "block", ["f", "g"], ["Bad"], NOW)], "id int, site_id bigint, action_taken string, risk_factors array<string>, flagged_categories array<string>, checked_at timestamp_ntz"
    )
    got = {r.site_id: (r.risk_score, r.risk_level) for r in runs.risk_run(frame, classes, checks).collect()}
    assert got == {1: (0.0, "low"), 2: (0.9, "low"), 3: (1.0, "critical"), 4: (0.9, "low"), 5: (0.9, "low")}
    seen = spark.createDataFrame(
        [(1, 1, "x", NOW + DAY), (2, 1, "y", NOW + 2 * DAY), (3, 2, "x", NOW + DAY), (4, 3, "x", NOW - 3 * DAY), (5, 3, "y", NOW - 2 * DAY)],
        "id int, site_id bigint, raw_content_hash string, discovered_at timestamp_ntz",
    )
    changed = {r.site_id: r.last_changed for r in runs.change_run(frame, seen).collect()}
    assert changed == {1: NOW + 2 * DAY, 2: NOW, 3: NOW, 4: NOW, 5: NOW}
    assert {r.site_id: r.last_changed for r in runs.change_run(sites(spark), seen).collect()} == {1: NOW + 2 * DAY, 2: None, 3: NOW - 2 * DAY, 4: None, 5: None}


def test_metrics_snapshot_and_audit_rows(spark):
    frame = sites(spark).withColumn("category", F.when(F.col("site_id") < 3, "blog"))
    log = spark.createDataFrame(
        [(NOW - timedelta(minutes=60), True, 2.0), (NOW - timedelta(minutes=61), True, 9.0), (NOW, False, 9.0), (NOW - timedelta(minutes=1), False, 4.0)],
        "ts timestamp_ntz, is_error boolean, response_time double",
    )
    states = spark.createDataFrame([("dead",), ("fresh",), ("active",)], "state string")
    checks = spark.range(7)
    row = runs.metrics_snapshot(frame, checks, log, states, NOW)
    assert row.columns == TABLES["system_metrics"].names
    row = row.first()
    assert (row.sites_discovered, row.sites_classified, row.safety_checks_performed, row.circuits_total, row.circuits_active) == (5, 2, 7, 3, 2)
    assert (row.requests_per_minute, row.error_rate, row.avg_response_time, row.timestamp, row.cpu_percent) == (2 / 60, 0.5, 3.0, NOW, None)
    empty = runs.metrics_snapshot(frame.limit(0), checks.limit(0), log.limit(0), states.limit(0), NOW).first()
    assert (empty.sites_discovered, empty.requests_per_minute, empty.error_rate) == (0, 0.0, None)

    entries = spark.createDataFrame([("c", "a", "success", None), ("c", "a", "success", None), ("c", "b", "failure", "why")], "component string, action string, status string, error_message string")
    rows = runs.audit_rows(entries, NOW)
    assert rows.columns == TABLES["audit_logs"].names and rows.count() == 2
    assert {r.created_at for r in rows.collect()} == {NOW} and quality.not_null_check(rows, "audit_logs").filter("n > 0").count() == 0


def test_a_model_classifies_sites_and_its_version_is_kept(spark, tmp_path):
    training = spark.createDataFrame([(1, "cart vendor", "market"), (2, "cart price vendor", "market"), (3, "thread reply", "forum"), (4, "reply thread user", "forum")], "doc_id int, text string, label string")
    bayes.fit_bayes(training).save(str(tmp_path / "m"))
    model = bayes.BayesModel.load(spark, str(tmp_path / "m"))
    frame = spark.createDataFrame([(1, None), (2, None), (3, "blog")], "site_id bigint, category string")
    contents = spark.createDataFrame([(1, "vendor vendor cart"), (1, "zzz"), (2, "nothing"), (3, "cart")], "site_id bigint, text string")
    run = classify_run(frame, contents, NOW, classifier=by_bayes(model), model_type="ml_supervised", model_version="m-1")
    rows = {r.site_id: r for r in run.classifications.collect()}
    assert rows.keys() == {1, 2} and rows[1].category == "market" and rows[1].confidence > 0.9
    assert {(r.model_type, r.model_version) for r in rows.values()} == {("ml_supervised", "m-1")}
    assert {r.site_id: (r.category, r.requires_review) for r in run.sites.collect()} == {1: ("market", False), 2: (None, True), 3: ("blog", False)}
    with pytest.raises(ValueError):
        classify_run(frame, contents, NOW, model_type="guess")


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_references_have_the_type_of_the_sites(spark, kind):
    a, b = address("a"), address("b")
    frame = spark.createDataFrame([(1, a, NOW, "active")], "site_id bigint, address string, last_checked timestamp_ntz, status string")
    frame = frame.withColumn("site_id", F.col("site_id").cast(kind))
    lines = spark.createDataFrame([(f"http://{a}",)], "value string")
    links = spark.createDataFrame([(a, f"http://{b}/{i}") for i in range(60)] + [(a, f"http://{b.upper()}/{i}") for i in range(60)], "src_address string, url string")
    run = discovery_run(lines, links, frame, NOW)
    children = {"discovery_results": run.discovery_results, "crawl_jobs": run.crawl_jobs}
    assert {dict(f.dtypes)["site_id"] for f in (run.sites, *children.values())} == {kind}
    assert quality.orphan_check(run.sites, children).count() == 0
    urls = {r.url for r in run.crawl_jobs.collect()}
    assert len(urls) == 50 and f"http://{b}/" in urls  # the root page first, though capitals sort before it
    for made in (append_discoveries(run.sites.select("site_id", F.lit("seed").alias("discovery_method")), NOW, "bigint"),
                 create_crawl_jobs(run.sites.select("site_id", F.col("address").alias("url")), NOW, "bigint")):
        assert [t for _, t in made.dtypes[:2]] == ["bigint", kind]
    with pytest.raises(ValueError):
        append_discoveries(run.sites.select("site_id", F.lit("seed").alias("discovery_method")), NOW, "date")


def test_typed_json(spark):
    texts = ['{"n": 5, "d": 2.5, "t": true, "s": "x", "a": [1, 2], "o": {"k": "v"}}', '{"n": "7", "a": "no"}', "{broken", None, "[3]", '{"n": null}', '{"n": 99999999999999999999}']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, j string").withColumn("v", json_variant("j"))
    got = frame.select(
        variant_value("v", "$.n", "bigint").alias("n"), variant_value("v", "$.d", "double").alias("d"), variant_value("v", "$.t", "boolean").alias("t"),
        variant_value("v", "$.a", "array<int>").alias("a"), variant_value("v", "$.o.k", "string").alias("k"), variant_value("v", "$[0]", "int").alias("first"), F.col("v").isNull().alias("broken"),
    ).collect()
    assert tuple(got[0]) == (5, 2.5, True, [1, 2], "v", None, False)
    assert (got[1].n, got[1].a) == (7, None)
    assert [r.broken for r in got] == [False, False, True, True, False, False, False]
    assert got[4].first == 3 and got[5].n is None and got[6].n is None
