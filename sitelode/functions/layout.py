"""Partitioning helpers: spreading small inputs, and exact windows over keys of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitelode.session import materialize

SPREAD_BYTES = 1024 * 1024 * 1024
SPREAD_BYTES_PER_TASK = 64 * 1024
SALTS = 256


def input_bytes(df: DataFrame, files: Sequence[str]) -> int:
    """Total size of some files, from their listing."""
    listed = df.sparkSession.read.format("binaryFile").load(list(files))
    return listed.agg(F.sum("length")).first()[0] or 0


def spread_small(df: DataFrame, *columns: str) -> DataFrame:
    """Hash a small input over the cores before work that is heavy per row.

    One small file is one scan task. An input with as many files as cores, or
    above `SPREAD_BYTES` in all, has enough splits already and is returned as it
    is, without a shuffle; so is one that reads no files. A stream is never spread.
    """
    if df.isStreaming:
        return df
    files, cores = df.inputFiles(), df.sparkSession.sparkContext.defaultParallelism
    if not files or len(files) >= cores:
        return df
    size = input_bytes(df, files)
    parts = min(cores, size // SPREAD_BYTES_PER_TASK)
    return df if size > SPREAD_BYTES or parts < 2 else df.repartition(parts, *columns)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str = "rank"
) -> DataFrame:
    """The first `limit` rows of every key in `order`, with their rank from 1.

    Two steps for all keys alike: the rows of a key are limited in up to `SALTS`
    parts by task, then together. So a hot key meets as `SALTS` x `limit` rows in the
    last step, and in each part as what a share of the tasks has left after
    limiting. The part of a row does not change the result.
    """
    def first(rows: DataFrame, part: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*part).orderBy(*order)
        return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)

    salted = df.withColumn("_salt", F.spark_partition_id() % SALTS)
    return first(first(salted, [*keys, "_salt"]).drop(rank, "_salt"), keys)


def _in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None) -> DataFrame:
    """Rows in ranges of (keys, order): `_part` is the range, `_row` the place in it.

    The ranges come from a sample of the rows, so a key of any size, null too, is
    cut along its own order into as many ranges as its share of the rows. Written
    once, so that every later step sees the same places.
    """
    wanted = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.asc_nulls_first(k) for k in keys], *order]
    ranged = df.repartitionByRange(wanted, *by).sortWithinPartitions(*by)
    return materialize(
        ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ranges"
    )


def _with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join what earlier ranges hand over: `carry` has at most one row per key and range."""
    names = {k: f"_carry_{i}" for i, k in enumerate([*keys, "_part"])}
    handed = carry.withColumnsRenamed(names)
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return rows.join(handed, same, "left").drop(*names.values())


def exact_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str, parts: int | None = None
) -> DataFrame:
    """`lag(value)` over (keys, order) for keys of any size and any sortable order.

    Adds the struct column `out` with field `v`; it is null on the first row of a
    key. Inside a range the value comes from an ordinary window, which no key can
    make larger than the range; the first row of a key in a range takes the last value of
    the key in the range before it.
    """
    rows = _in_ranges(df.withColumn("_value", F.struct(F.col(value).alias("v"))), keys, order, parts)
    local = rows.withColumn("_local", F.lag("_value").over(Window.partitionBy(*keys, "_part").orderBy("_row")))
    ends = rows.groupBy(*keys, "_part").agg(F.max_by("_value", "_row").alias("_end"))
    earlier = F.lag("_end").over(Window.partitionBy(*keys).orderBy("_part"))
    carry = ends.select(*keys, "_part", earlier.alias("_carry")).filter(F.col("_carry").isNotNull())
    joined = _with_carry(local, carry, keys).withColumn(out, F.coalesce("_local", "_carry"))
    return joined.select(*df.columns, out)


def exact_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str, parts: int | None = None
) -> DataFrame:
    """Running sum over (keys, order), row by row, cut into ranges as in `exact_lag`."""
    rows = _in_ranges(df, keys, order, parts)
    inside = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum(value).over(inside))
    totals = rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_part", F.sum("_total").over(before).alias("_carry")).filter(F.col("_carry").isNotNull())
    summed = F.when(F.col("_carry").isNull(), F.col("_local")).otherwise(F.col("_carry") + F.coalesce("_local", F.lit(0)))
    return _with_carry(local, carry, keys).withColumn(out, summed).select(*df.columns, out)
