import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitelode.operators.metrics import audit_filter
from sitelode.operators.quality import fill_defaults
from sitelode.schema import TABLES, table_schema
from sitelode.session import materialize, shared_dir
from sitelode.sources import catalog_io
from sitelode.sources.text_lists import seed_parse

NOW = datetime(2024, 5, 2, 12, 0, 0)


def jobs(spark, *ids):
    frame = spark.createDataFrame([(i, "s", f"http://{i}/") for i in ids], "job_id string, site_id string, url string")
    return fill_defaults(frame, "crawl_jobs", NOW, add_missing=True)


def test_catalog_round_trip(spark, tmp_path):
    root = str(tmp_path / "catalog")
    catalog_io.append_rows(jobs(spark, "a"), root, "crawl_jobs")
    catalog_io.append_rows(jobs(spark, "b", "c"), root, "crawl_jobs")
    tables = catalog_io.load_catalog(spark, root)
    assert set(tables) == set(TABLES)
    assert sorted(r.job_id for r in tables["crawl_jobs"].collect()) == ["a", "b", "c"]
    assert tables["crawl_jobs"].columns == TABLES["crawl_jobs"].names
    assert tables["sites"].count() == 0 and tables["sites"].columns == TABLES["sites"].names


def test_versions_are_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "versions")
    assert catalog_io.current_version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        catalog_io.read_current(spark, root, "crawl_jobs")
    assert catalog_io.write_atomic(spark, root, {"crawl_jobs": jobs(spark, "a")}) == 1
    broken = jobs(spark, "b").withColumn("url", F.raise_error(F.lit("broken row")).cast("string"))
    with pytest.raises(Exception, match="broken row"):
        catalog_io.write_atomic(spark, root, {"crawl_jobs": jobs(spark, "b"), "sites": broken})
    assert [r.job_id for r in catalog_io.read_current(spark, root, "crawl_jobs").collect()] == ["a"]
    current = catalog_io.read_current(spark, root, "crawl_jobs")
    assert catalog_io.write_atomic(spark, root, {"crawl_jobs": current.unionByName(jobs(spark, "c"))}) == 3
    assert catalog_io.read_current(spark, root, "crawl_jobs").count() == 2
    audit = spark.createDataFrame([], table_schema("audit_logs"))
    assert catalog_io.write_atomic(spark, root, {"audit_logs": audit}) == 4
    assert catalog_io.read_current(spark, root, "crawl_jobs").count() == 2  # kept by a version without it
    with pytest.raises(FileNotFoundError):
        catalog_io.read_current(spark, root, "classifications")
    loaded = catalog_io.load_catalog(spark, root)
    assert loaded["crawl_jobs"].count() == 2 and loaded["sites"].isEmpty()
    catalog_io.append_rows(loaded["crawl_jobs"].limit(1), root, "crawl_jobs")
    assert catalog_io.load_catalog(spark, root)["crawl_jobs"].count() == 3


def test_relational_names_there_and_back(spark):
    frame = spark.createDataFrame([("7", "a.onion")], "id string, onion_address string")
    back = catalog_io.to_source(catalog_io.from_source(frame, "sites"), "sites")
    assert back.select("id", "onion_address").collect() == frame.collect()


def test_json_is_iso_and_keeps_nulls(spark, tmp_path):
    frame = spark.createDataFrame(
        [(1, NOW, None, ["x"]), (2, NOW.replace(microsecond=120), NOW, None)],
        "id int, seen timestamp_ntz, checked timestamp_ntz, tags array<string>",
    )
    out = str(tmp_path / "json")
    catalog_io.export_json(frame, out)
    rows = sorted((json.loads(r.value) for r in spark.read.text(out).collect()), key=lambda r: r["id"])
    assert rows == [
        {"id": 1, "seen": "2024-05-02T12:00:00", "checked": None, "tags": ["x"]},
        {"id": 2, "seen": NOW.replace(microsecond=120).isoformat(), "checked": NOW.isoformat(), "tags": None},
    ]


def test_address_layouts(spark):
    sites = spark.range(500).select("id", F.sha2(F.col("id").cast("string"), 256).alias("address"))
    spread = catalog_io.layout_by_address(sites, 7)
    assert spread.rdd.getNumPartitions() == 7
    one_home = spread.withColumn("p", F.spark_partition_id()).groupBy("address").agg(F.count_distinct("p").alias("n"))
    assert one_home.filter("n > 1").count() == 0

    catalog_io.save_bucketed(sites, "sites_by_address", 4)
    saved = spark.table("sites_by_address")
    joined = saved.join(saved.select("address", F.col("id").alias("other")).hint("merge"), "address")
    assert joined.count() == 500
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString().replace("ReusedExchange", "")
    spark.sql("DROP TABLE sites_by_address")

    edges = spark.range(300).select((F.col("id") % 30).alias("src"), F.col("id").alias("dst"))
    catalog_io.save_bucketed(edges, "edges_by_src", 4, "src")
    frontier = spark.range(20).withColumnRenamed("id", "src").hint("merge")
    step = spark.table("edges_by_src").join(frontier, "src")
    assert step.count() == 200 and step._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    spark.sql("DROP TABLE edges_by_src")


def test_audit_layout_prunes_days(spark, tmp_path):
    logs = spark.createDataFrame(
        [("a", NOW), ("b", NOW.replace(day=3)), ("c", NOW.replace(day=4))], "component string, created_at timestamp_ntz"
    ).withColumn("action", F.lit("x"))
    path = str(tmp_path / "audit")
    catalog_io.write_audit_layout(logs, path)
    day = spark.read.parquet(path).filter("day = DATE '2024-05-03'")
    assert [r.component for r in day.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()
    ranged = audit_filter(spark.read.parquet(path), since="2024-05-02 13:00:00", until="2024-05-04 00:00:00")
    assert [r.component for r in ranged.collect()] == ["b"]
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day[^\]]* >= 2024-05-02", plan)


def test_relational_names_and_types(spark):
    frame = spark.createDataFrame([("7", "a.onion", NOW, True, 5)], "id string, onion_address string, first_seen timestamp_ntz, is_honeypot boolean, extra int")
    sites = catalog_io.from_source(frame, "sites")
    assert sites.schema == table_schema("sites") and sites.first().address == "a.onion"
    job = catalog_io.from_source(frame.select("id"), "crawl_jobs", "bigint").first()
    assert job.job_id == 7 and job.status is None


def test_seed_file(spark, tmp_path):
    file = tmp_path / "seeds.txt"
    file.write_text("# list\n\nhttp://" + "a" * 56 + ".onion\n")
    assert [r.is_valid for r in seed_parse(spark.read.text(str(file))).collect()] == [True]


def test_materialize_uses_the_shared_folder(spark):
    frame = materialize(spark.range(10).withColumn("x", F.col("id") * 2))
    assert frame.agg(F.sum("x")).first()[0] == 90
    assert all(shared_dir(spark) in f for f in frame.inputFiles())
    assert materialize(spark.range(0)).count() == 0
