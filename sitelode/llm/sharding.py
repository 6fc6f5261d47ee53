"""Sharding by jump consistent hashing, with gapless places inside every shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sitelode.llm.common import shuffle_partitions
from sitelode.session import materialize

#: Fixed values of the published algorithm: multiplier of its generator and the word size.
MULTIPLIER = "2862933555777941757BD"
WORD = "18446744073709551616BD"


def stable_key(*columns: str | Column, integral: bool = False) -> Column:
    """The 64-bit key of a row as an unsigned number.

    One integral column is its own key (negative numbers wrap); anything else is
    hashed. A null integral key counts as 0.
    """
    value = F.coalesce(F.col(columns[0]) if isinstance(columns[0], str) else columns[0], F.lit(0)) if integral else F.xxhash64(*columns)
    number = value.cast("decimal(20,0)")
    return F.when(number < 0, number + F.expr(WORD)).otherwise(number).cast("decimal(20,0)")


def jump_shard(key: str, shards: int) -> Column:
    """Shard 0..shards-1 of the unsigned key column `key`.

    Jump consistent hashing: the key seeds a generator whose draws say at which
    shard count the key jumps next; the last jump below `shards` is its shard. So
    one more shard takes rows only into itself. No ring table, no lookup. Each
    jump goes up by at least one, hence `shards` steps are always enough; steps
    after the last jump do nothing.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    def drawn(k):
        return f"CAST(({k} * {MULTIPLIER} + 1BD) % {WORD} AS decimal(20,0))"

    return F.expr(
        f"""CAST(aggregate(sequence(1, {shards}),
            named_struct('k', {drawn(f'CAST({key} AS decimal(20,0))')}, 'b', -1L, 'j', 0L),
            (s, i) -> IF(s.j >= {shards}L, s, named_struct(
                'k', {drawn('s.k')},
                'b', s.j,
                'j', CAST(CAST(s.j + 1L AS double) * (2147483648D / CAST((s.k div 8589934592BD) + 1L AS double)) AS bigint))),
            s -> s.b) AS int)"""
    )


def shard(
    df: DataFrame, key: str, shards: int, *, carry: Sequence[str] = (), order: Sequence[str] = ()
) -> DataFrame:
    """Rows of `df` dealt to `shards` shards: key, `carry`, shard, slot, grown_shard.

    `key` alone and the shard count decide the shard. `grown_shard` is the shard
    under one shard more. `slot` counts the rows of a shard gapless from 0 in the
    order of key and `order`; among equal rows the order is open. Null keys form
    one key (as 0 does, if integral); repeated rows are kept and numbered. An empty table gives no rows.
    Other columns of `df` are not read.

    Places need no global or per-shard sort in one task: rows are range-partitioned
    by (shard, key), numbered inside their partition, and shifted by counts of
    earlier partitions, a table of at most partitions + shards rows.
    """
    integral = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    keyed = df.select(key, *carry, *[c for c in order if c not in carry], stable_key(key, integral=integral).alias("_key"))
    dealt = materialize(
        keyed.select(
            *[c for c in keyed.columns if c != "_key"],
            jump_shard("_key", shards).alias("shard"),
            jump_shard("_key", shards + 1).alias("grown_shard"),
        ),
        "dealt",
    )
    by = ["shard", key, *order]
    ranged = dealt.repartitionByRange(shuffle_partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    numbered = materialize(
        ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "numbered"
    )
    runs = numbered.groupBy("shard", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        "shard", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return numbered.join(shifts, ["shard", "_part"]).select(
        key, *carry, "shard", (F.col("_row") + F.col("_shift")).alias("slot"), "grown_shard"
    )


def with_text_size(df: DataFrame, text: str = "text") -> DataFrame:
    """Add size (UTF-8 bytes of the text plus 8) and text_crc32; a null text has no bytes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"size": (F.octet_length(whole) + 8).cast("bigint"), "text_crc32": F.crc32(whole.cast("binary"))})
