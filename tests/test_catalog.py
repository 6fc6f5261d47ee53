from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitelode.operators import catalog, search

NOW = datetime(2024, 5, 2, 12, 0, 0)
DAY = timedelta(hours=24)
SITE = (
    "site_id bigint, address string, first_seen timestamp_ntz, last_checked timestamp_ntz, status string, "
    "category string, risk_score double, language string, title string, description string, "
    "is_honeypot boolean, is_illegal boolean, tags array<string>"
)


def site(site_id, **values):
    row = {
        "site_id": site_id, "address": f"a{site_id}.onion", "first_seen": NOW, "last_checked": None, "status": "active",
        "category": None, "risk_score": 0.5, "language": "en", "title": f"Title {site_id}", "description": None,
        "is_honeypot": False, "is_illegal": False, "tags": None,
    }
    return tuple({**row, **values}.values())


def sites(spark, *rows):
    return spark.createDataFrame(list(rows), SITE)


def ids(frame):
    return [r.site_id for r in frame.collect()]


def test_pending_sites_rules(spark):
    frame = sites(
        spark,
        site(1, last_checked=NOW - DAY),  # exactly 24 h ago: not due
        site(2, last_checked=NOW - DAY - timedelta(microseconds=1)),
        site(3),
        site(4, is_honeypot=None),  # a null flag excludes
        site(5, is_illegal=None),
        site(6, status="dead"),
        site(7, is_honeypot=True),
        site(8, last_checked=NOW - 3 * DAY, status="discovered"),
    )
    assert ids(catalog.pending_sites(frame, NOW)) == [3, 8, 2]
    assert ids(catalog.pending_sites(frame, NOW, limit=1)) == [3]


def test_search_order_offset_and_filters(spark):
    frame = sites(
        spark,
        site(1, last_checked=NOW),
        site(2, last_checked=NOW + DAY, category="market"),
        site(3, description="red TITLE"),
        site(4, title=None, description=None),
        site(5, last_checked=NOW, language="de"),
    )
    assert ids(catalog.search_sites(frame, "title")) == [3, 2, 1, 5]
    assert ids(catalog.search_sites(frame, "title", limit=2, offset=1)) == [2, 1]
    assert ids(catalog.search_sites(frame, "", category=None, status="", language="")) == [3, 4, 2, 1, 5]
    assert ids(catalog.search_sites(frame, "title", category="market")) == [2]
    assert ids(catalog.search_sites(frame, "A4.ONION")) == [4]
    assert ids(catalog.search_sites(frame, language="de", status="active")) == [5]


def test_search_wildcards_are_live_unless_escaped(spark):
    frame = sites(spark, site(1, title="axb"), site(2, title="a_b"), site(3, title="100% sure"))
    assert ids(catalog.search_sites(frame, "a_b")) == [1, 2]
    assert ids(catalog.search_sites(frame, "a_b", escape=True)) == [2]
    assert ids(catalog.search_sites(frame, "0% s", escape=True)) == [3]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_search_batch_with_and_without_broadcast(spark, threshold):
    """Repeated and null site ids stay rows of their own either way."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        frame = sites(spark, site(1, title="axb Shop"), site(1, title="other shop"), site(2, title="shop"))
        frame = frame.unionByName(frame.filter("site_id = 2").withColumn("site_id", F.lit(None).cast("bigint")))
        queries = spark.createDataFrame([(7, "shop"), (8, "other")], "query_id int, query string")
        found = [(r.query_id, r.site_id) for r in search.search_batch(frame, queries).collect()]
        assert sorted(found, key=str) == sorted([(7, 1), (7, 1), (7, 2), (7, None), (8, 1)], key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_search_batch_equals_single_searches(spark):
    frame = sites(
        spark, site(1, title="axb Shop"), site(2, title="a_b shop", last_checked=NOW), site(3, title=None),
        site(4, title="ÄRGER shop", last_checked=NOW - DAY), site(5, description="say 50% off"),
    )
    wanted = ["shop", "a_b", "SHOP", "ärger", "x", "%", "__________", "s%p", "50\\% o", "nothing here", "a5", ""]
    queries = spark.createDataFrame(list(enumerate(wanted)), "query_id int, query string")
    for limit in (2, 100):
        got = {}
        for row in search.search_batch(frame, queries, limit).orderBy("query_id", "rank").collect():
            got.setdefault(row.query_id, []).append(row.site_id)
        for query_id, query in enumerate(wanted):
            assert got.get(query_id, []) == ids(catalog.search_sites(frame, query, limit=limit)), query


def test_lookups_keep_missing_keys(spark):
    frame = sites(spark, site(1), site(2))
    keys = spark.createDataFrame([(1,), (9,)], "site_id bigint")
    assert {(r.site_id, r.address) for r in catalog.site_by_id(frame, keys).collect()} == {(1, "a1.onion"), (9, None)}
    named = spark.createDataFrame([("a2.onion",), ("A2.onion",)], "address string")
    assert {(r.address, r.site_id) for r in catalog.site_by_address(frame, named).collect()} == {("a2.onion", 2), ("A2.onion", None)}


UPDATE = "seq bigint, address string, status string, risk_score double, title string, is_honeypot boolean, tags array<string>"


def updates(spark, *rows):
    return spark.createDataFrame(list(rows), UPDATE)


def as_dict(frame):
    return {r.address: r.asDict() for r in frame.collect()}


def test_upsert_sequence_rules(spark):
    frame = sites(spark, site(1, is_honeypot=True, tags=["x"]), site(2, is_illegal=None))
    batch = updates(
        spark,
        (1, "a1.onion", "dead", 0.9, "first", None, None),
        (2, "a1.onion", None, 0.0, "", False, []),
        (3, "new.onion", None, None, None, None, None),
        (4, "twice.onion", "scam", None, None, None, None),
        (5, "twice.onion", None, 0.25, None, None, ["y"]),
    )
    got = as_dict(catalog.site_upsert(frame, batch, NOW, new_id=F.lit(None)))
    one = got["a1.onion"]
    assert (one["status"], one["risk_score"], one["title"], one["is_honeypot"], one["tags"]) == ("dead", 0.0, "", False, [])
    assert one["last_checked"] == NOW and one["site_id"] == 1
    assert got["a2.onion"]["last_checked"] is None and got["a2.onion"]["is_illegal"] is None
    new = got["new.onion"]
    assert (new["status"], new["risk_score"], new["is_illegal"], new["first_seen"]) == ("discovered", 0.0, False, NOW)
    assert new["last_checked"] is None
    twice = got["twice.onion"]
    assert (twice["last_checked"], twice["status"], twice["risk_score"], twice["tags"]) == (NOW, "scam", 0.25, ["y"])


def test_upsert_supplied_last_checked_and_unknown_columns(spark):
    frame = sites(spark, site(1))
    early = NOW - 5 * DAY
    batch = spark.createDataFrame(
        [(1, "a1.onion", early), (2, "new.onion", early)], "seq int, address string, last_checked timestamp_ntz"
    )
    got = as_dict(catalog.site_upsert(frame, batch, NOW, new_id=F.lit(None)))
    assert got["a1.onion"]["last_checked"] == NOW and got["new.onion"]["last_checked"] == early
    with pytest.raises(ValueError):
        catalog.site_upsert(frame, batch.withColumn("colour", F.lit("red")), NOW)


def test_upsert_batch_equals_one_by_one_and_is_stable(spark):
    frame = sites(spark, site(1), site(2), site(3))
    rows = [
        (i, f"a{i * 7 % 5 + 1}.onion", [None, "dead", "scam"][i % 3], [None, i / 10][i % 2], [f"t{i}", None][i % 2], None, None)
        for i in range(8)
    ]
    whole = catalog.site_upsert(frame, updates(spark, *rows), NOW, new_id=F.lit(None))
    step = frame
    for row in rows:
        step = catalog.site_upsert(step, updates(spark, row), NOW, new_id=F.lit(None))
    assert as_dict(whole) == as_dict(step)
    later = NOW + DAY
    again = as_dict(catalog.site_upsert(whole, updates(spark, *rows), later, new_id=F.lit(None)))
    touched = {r[1] for r in rows}
    for address, before in as_dict(whole).items():
        expected = {**before, "last_checked": later} if address in touched else before
        assert again[address] == expected


def test_new_string_ids_are_repeatable(spark):
    frame = sites(spark, site(1)).withColumn("site_id", F.col("site_id").cast("string"))
    batch = updates(spark, (1, "new.onion", None, None, None, None, None))
    first, second = (as_dict(catalog.site_upsert(frame, batch, NOW))["new.onion"]["site_id"] for _ in range(2))
    assert first == second and len(first) == 64


def test_new_number_ids_and_updates_without_address(spark):
    frame = sites(spark, site(1))
    batch = updates(spark, (1, "new.onion", None, None, None, None, None), (2, None, "dead", None, None, None, None), (3, "other.onion", None, None, None, None, None))
    got = as_dict(catalog.site_upsert(frame, batch, NOW))
    assert got.keys() == {"a1.onion", "new.onion", "other.onion"}
    fresh = {got[a]["site_id"] for a in ("new.onion", "other.onion")}
    assert len(fresh) == 2 and all(0 <= i < 1 << 60 for i in fresh)
    assert [(r.seq, r.problem) for r in catalog.rejected_updates(batch).collect()] == [(2, "no address")]
    with pytest.raises(ValueError):
        catalog.site_upsert(frame.withColumn("site_id", F.col("site_id").cast("int")), batch, NOW)


def test_children_and_deletion(spark):
    frame = sites(spark, site(1), site(2), site(3))
    child = lambda time, rows: spark.createDataFrame(rows, f"id bigint, site_id bigint, {time} timestamp_ntz")
    found = child("discovered_at", [(1, 1, NOW), (2, 1, NOW + DAY), (3, 2, NOW)])
    classes, checks = child("classified_at", [(1, 1, NOW)]), child("checked_at", [(1, 3, NOW)])
    jobs = child("created_at", [(1, 1, NOW), (2, 1, NOW)])
    counts = {r.site_id: r for r in catalog.site_children(frame, found, classes, checks, jobs).collect()}
    assert (counts[1].n_discoveries, counts[1].n_classifications, counts[1].n_checks, counts[1].n_jobs) == (2, 1, 0, 2)
    assert counts[1].last_discoveries == NOW + DAY and counts[2].last_jobs is None
    assert catalog.children_with_site(found, frame).filter("site_address = 'a1.onion'").count() == 2

    tables = {
        "sites": frame, "discovery_results": found, "classifications": classes, "safety_checks": checks,
        "crawl_jobs": jobs, "content_hashes": child("created_at", [(1, 2, NOW)]),
    }
    remaining, refused = catalog.cascade_delete(tables, spark.createDataFrame([(1,), (2,)], "site_id bigint"))
    assert ids(refused) == [2]
    assert sorted(ids(remaining["sites"])) == [2, 3]
    assert {n: remaining[n].count() for n in tables} == {
        "sites": 2, "discovery_results": 1, "classifications": 0, "safety_checks": 1, "crawl_jobs": 0, "content_hashes": 1,
    }


def test_honeypots_and_new_addresses(spark):
    frame = sites(spark, site(1), site(2))
    known = spark.createDataFrame([("a2.onion",), ("a2.onion",), ("zz",)], "address string")
    assert {r.site_id: r.known_honeypot for r in catalog.honeypot_flag(frame, known).collect()} == {1: False, 2: True}
    assert [r.address for r in catalog.new_addresses(known, frame).collect()] == ["zz"]
