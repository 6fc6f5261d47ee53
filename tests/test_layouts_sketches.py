"""Address layout with skipped row groups; stored sketches that merge."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitelode.operators import metrics, sketches
from sitelode.sources import catalog_io

NOW = datetime(2024, 5, 2)


def scanned_rows(frame):
    """Rows the scan of a plan without shuffles hands on."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_a_few_addresses_skip_nearly_all_row_groups(spark, tmp_path):
    n, path = 20_000, str(tmp_path / "layout")
    sites = spark.range(n).select("id", F.concat(F.md5(F.col("id").cast("string")), F.lit(".onion")).alias("address"))
    catalog_io.write_address_layout(sites.withColumnRenamed("id", "site_id"), path, files=16, rows_per_file=2000)
    layout = spark.read.parquet(path)
    assert layout.count() == n and len(layout.inputFiles()) == 16
    known = sites.filter("id = 77").first().address
    keys = spark.createDataFrame([(known,), (known,), (None,)], "address string")
    found = catalog_io.lookup_addresses(layout, keys)
    assert [r.site_id for r in found.collect()] == [77]
    assert scanned_rows(found) <= n / 8
    # an address inside the range of a file, but in none: the bloom filter answers
    absent = catalog_io.lookup_addresses(layout, spark.createDataFrame([(known[:-7] + "é.onion",)], "address string"))
    assert scanned_rows(absent) == 0
    many = sites.filter("id % 100 = 0").select("address").unionByName(keys)
    assert {r.site_id for r in catalog_io.lookup_addresses(layout, many).collect()} == {77, *range(0, n, 100)}
    assert catalog_io.lookup_addresses(layout, keys.filter("address IS NULL")).collect() == []


def results(spark):
    rows = [(("seed", "crawl", None)[i % 3], NOW + timedelta(days=i % 5), i % 2500 if i % 11 else None, 0.5 if i % 2 else None) for i in range(30_000)]
    return spark.createDataFrame(rows, "discovery_method string, discovered_at timestamp_ntz, site_id bigint, confidence double")


def test_days_merge_to_what_one_sketch_says(spark, tmp_path):
    frame = results(spark)
    daily = sketches.daily_sketches(frame)
    for day in range(5):  # day after day, as a log grows
        part = frame.filter(F.col("discovered_at") == F.lit(str(NOW + timedelta(days=day))).cast("timestamp_ntz"))
        sketches.daily_sketches(part).write.mode("append").partitionBy("day").parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    assert stored.count() == daily.count() == 15
    columns = ["discovery_method", "n_results", "n_sites", "mean_confidence"]
    merged = {tuple(r) for r in sketches.discovery_by_method_estimated(stored).select(columns).collect()}
    assert merged == {tuple(r) for r in sketches.discovery_by_method_estimated(daily).select(columns).collect()}
    direct = {r.discovery_method: r.n for r in frame.groupBy("discovery_method").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site_id", sketches.LG_K)).alias("n")).collect()}
    exact = {r.discovery_method: r for r in metrics.discovery_by_method(frame).collect()}
    for method, n_results, n_sites, mean in merged:
        assert n_results == exact[method].n_results and mean == exact[method].mean_confidence
        assert abs(n_sites - exact[method].n_sites) <= 4 * sketches.STANDARD_ERROR * exact[method].n_sites
        assert abs(n_sites - direct[method]) <= 2 * sketches.STANDARD_ERROR * direct[method]
    # merged rows can be merged again, in any grouping
    halves = sketches.merged_sketches(stored, ["discovery_method", "day"])
    assert {tuple(r) for r in sketches.discovery_by_method_estimated(halves).select(columns).collect()} == merged


def test_sketches_of_nothing(spark):
    empty = results(spark).limit(0)
    assert sketches.discovery_by_method_estimated(sketches.daily_sketches(empty)).collect() == []
    nulls = results(spark).limit(20).withColumns({"site_id": F.lit(None).cast("bigint"), "confidence": F.lit(None).cast("double")})
    assert {(r.n_sites, r.mean_confidence) for r in sketches.discovery_by_method_estimated(sketches.daily_sketches(nulls)).collect()} == {(0, None)}
