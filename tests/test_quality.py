from datetime import datetime

from sitelode.operators import quality
from sitelode.schema import TABLES, table_schema

NOW = datetime(2024, 5, 2)


def test_address_rules(spark):
    rows = [("a" * 55 + ".onion",), ("a" * 56 + ".onion",), ("a" * 57 + ".onion",), ("a" * 62,), ("x.onion.com",), (None,)]
    frame = quality.address_validate(spark.createDataFrame(rows, "address string"))
    errors = [r.error for r in frame.collect()]
    assert errors == [quality.BAD_LENGTH, None, quality.BAD_LENGTH, quality.BAD_SUFFIX, quality.BAD_SUFFIX, quality.BAD_SUFFIX]


def test_range_includes_both_ends_and_null_is_a_type_problem(spark):
    frame = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.01), (4, -0.1), (5, None)], "id int, confidence double")
    found = {r.id: r.problem for r in quality.range_check(frame, "confidence", "id").collect()}
    assert found == {3: "range", 4: "range", 5: "type"}


def test_domain_check_counts_values_per_column(spark):
    frame = spark.createDataFrame(
        [("active", "forum"), ("unknown", "forum"), ("unknown", "shop"), (None, None)], "status string, category string"
    )
    found = {(r.column_name, r.value): r.n for r in quality.domain_check(frame, "sites").collect()}
    assert found == {("status", "unknown"): 2, ("category", "shop"): 1}
    assert quality.domain_check(spark.createDataFrame([(1,)], "id int"), "system_metrics").count() == 0


def test_null_and_length_checks(spark):
    frame = spark.createDataFrame(
        [("a", None, "x" * 11), (None, "active", "en"), ("b", "active", None)], "address string, status string, language string"
    )
    assert {r.column_name: r.n for r in quality.not_null_check(frame, "sites").collect()} == {"address": 1, "status": 1}
    assert {r.column_name: r.n for r in quality.length_check(frame, "sites").collect()} == {"language": 1}


def test_unique_check_ignores_null_keys(spark):
    frame = spark.createDataFrame([("h", "en"), ("h", "en"), ("h", None), ("h", None), (None, None)], "title_hash string, language string")
    assert [(r.title_hash, r.language, r.n) for r in quality.unique_check(frame, ["title_hash", "language"]).collect()] == [("h", "en", 2)]


def test_orphans_per_table(spark):
    sites = spark.createDataFrame([(1,), (2,)], "site_id bigint")
    child = spark.createDataFrame([(1,), (3,), (3,)], "site_id bigint")
    found = quality.orphan_check(sites, {"crawl_jobs": child, "classifications": sites})
    assert [(r.table_name, r.site_id, r.n) for r in found.collect()] == [("crawl_jobs", 3, 2)]


def test_defaults_fill_only_nulls_and_add_missing_columns(spark):
    frame = spark.createDataFrame([("j1", "s1", "u", 7, None), ("j2", "s1", "u", None, "failed")],
                                  "job_id string, site_id string, url string, priority int, status string")
    filled = quality.fill_defaults(frame, "crawl_jobs", NOW, add_missing=True)
    assert filled.columns == TABLES["crawl_jobs"].names
    rows = {r.job_id: r for r in filled.collect()}
    assert (rows["j1"].priority, rows["j1"].status, rows["j1"].max_depth, rows["j1"].max_retries) == (7, "pending", 1, 3)
    assert (rows["j2"].priority, rows["j2"].status) == (0, "failed")
    assert rows["j1"].created_at == NOW and rows["j1"].scheduled_for is None and rows["j1"].started_at is None
    assert quality.fill_defaults(frame, "crawl_jobs", NOW).columns == frame.columns


def test_schemas_of_all_tables():
    assert len(TABLES) == 8
    sites = table_schema("sites", "bigint")
    assert sites["site_id"].dataType.simpleString() == "bigint"
    assert sites["first_seen"].dataType.simpleString() == "timestamp_ntz"
    assert table_schema("system_metrics")["tor_traffic_read"].dataType.simpleString() == "bigint"


def test_declared_unique_constraints(spark):
    frame = spark.createDataFrame(
        [(1, "a", "h", "en"), (2, "a", "h", "en"), (3, "b", "h", None), (3, "c", "h", None)],
        "site_id int, address string, title_hash string, language string",
    )
    found = {r.key_columns: r.n_keys for r in quality.declared_unique_check(frame, "sites").collect()}
    assert found == {"site_id": 1, "address": 1, "title_hash,language": 1}
    hashes = spark.createDataFrame([(1, 1, "title"), (2, 1, "title")], "id int, site_id int, hash_type string")
    found = {r.key_columns: r.n_keys for r in quality.declared_unique_check(hashes, "content_hashes").collect()}
    assert found == {"id": 0, "site_id,hash_type": 1}
