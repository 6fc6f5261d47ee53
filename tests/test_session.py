from types import SimpleNamespace

import pytest
from pyspark.sql import Window, functions as F

from sitelode.functions import layout
from sitelode.session import scratch_path, shared_dir


def session(master, named=None):
    """Just enough of a session to ask for its shared folder."""
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: named),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_shared_folder_comes_from_the_session():
    assert shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert scratch_path(session("yarn", "hdfs:///shared"), "x") != scratch_path(session("yarn", "hdfs:///shared"), "x")
    with pytest.raises(RuntimeError):
        shared_dir(session("yarn"))
    assert shared_dir(session("local[2]")) == shared_dir(session("local[2]"))


def test_only_small_inputs_are_spread(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "one")
    spark.range(1000).select("id", F.repeat(F.lit("x"), 50).alias("text")).coalesce(1).write.parquet(path)
    frame = spark.read.parquet(path)
    monkeypatch.setattr(layout, "input_bytes", lambda df, files: 10 * layout.SPREAD_BYTES_PER_TASK)
    spread = layout.spread_small(frame, "id")
    assert "Exchange hashpartitioning(id" in spread._jdf.queryExecution().executedPlan().toString()
    for size in (layout.SPREAD_BYTES_PER_TASK, 10**15):  # a single task's worth, and a large table
        monkeypatch.setattr(layout, "input_bytes", lambda df, files, size=size: size)
        assert layout.spread_small(frame, "id") is frame
    no_files = spark.range(3)
    assert layout.spread_small(no_files, "id") is no_files


def test_input_size(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    table = spark.read.parquet(path)
    assert 0 < layout.input_bytes(table, table.inputFiles()) < 10**6


IDS = {
    "bigint": "id * 7919 % 100003",
    "smallint": "cast(id * 89 % 997 as smallint)",
    "sparse": "xxhash64(id)",
    "decimal": "cast(id * 7919 % 100003 as decimal(20,0)) * 1000000000000",
    "prefixed": "concat('job-', lpad(cast(id * 7919 % 100003 as string), 9, '0'))",
}


@pytest.mark.parametrize("kind", IDS)
@pytest.mark.parametrize("parts", [1, 3, 13])
def test_windows_equal_plain_windows_for_any_id_and_key(spark, kind, parts):
    """Hot, ordinary and null keys; ids of all kinds."""
    frame = spark.range(400).select(
        F.expr(IDS[kind]).alias("at"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 20)).alias("key"),
        F.when(F.col("id") % 9 != 0, F.col("id") % 5).alias("x"),
    )
    order = Window.partitionBy("key").orderBy("at")
    wanted = frame.withColumns({"s": F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, 0)), "l": F.lag("x").over(order)})
    summed = layout.exact_running_sum(frame, ["key"], [F.asc("at")], "x", "s", parts)
    lagged = layout.exact_lag(frame, ["key"], [F.asc("at")], "x", "l", parts).withColumn("l", F.col("l.v"))
    plain = lambda df, c: sorted(map(str, df.select("at", "key", "x", c).collect()))
    assert plain(summed, "s") == plain(wanted, "s") and plain(lagged, "l") == plain(wanted, "l")


@pytest.mark.parametrize("limit", [1, 7, 2000])
def test_first_rows_of_each_key(spark, limit):
    frame = spark.range(0, 3000, numPartitions=9).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("key"))
    got = layout.top_per_group(frame, ["key"], [F.desc("id")], limit)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("id")))
    wanted = frame.withColumn("rank", rank).filter(F.col("rank") <= limit)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
