"""Conflict-constrained best-fit packing of texts into training sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sitelode.llm.common import words_of

CAPACITY = 4096
GROUP_ROWS = 4000


def text_length(text: Column) -> Column:
    """Words of a text plus one for the end mark; null counts as empty."""
    return (F.size(words_of(text)) + 1).cast("bigint")


def best_fit(lengths, sources, clusters, capacity: int) -> np.ndarray:
    """Bin number of each item, items taken in the order given.

    Open bins are ordered by residual room, then number. The search starts at the
    tightest bin with room for the item and goes to the next one until neither
    the bin's source bitmap nor its cluster bitmap has the item's bit; without
    such a bin a new one is opened. A negative source or cluster conflicts with
    nothing.
    """
    bins = np.empty(len(lengths), dtype=np.int64)
    room: list[tuple[int, int]] = []  # residual, bin: sorted
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    for i, (length, source, cluster) in enumerate(zip(lengths, sources, clusters)):
        source_bit = 1 << source if source >= 0 else 0
        cluster_bit = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(room, (length, -1))
        while at < len(room) and (source_bits[room[at][1]] & source_bit or cluster_bits[room[at][1]] & cluster_bit):
            at += 1
        if at < len(room):
            left, chosen = room.pop(at)
        else:
            left, chosen = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[chosen] |= source_bit
        cluster_bits[chosen] |= cluster_bit
        if left > length:
            insort(room, (left - length, chosen))
        bins[i] = chosen
    return bins


def pack(
    df: DataFrame,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    cluster: Column | None = None,
    length: Column | None = None,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Deal texts to bins of `capacity`: doc_id, piece, n_pieces, length, offset, pack_group, bin, place.

    No bin holds two texts of one cluster (default: equal texts) or two texts of one
    source; pieces of one text conflict with each other in the same way. A text longer than
    `capacity` is cut into whole pieces, each a bin of its own, and a rest that is
    packed like a text; nothing is dropped. Length 0 takes a place, too. A null source conflicts with nothing, a
    null text is an empty text. Repeated rows are packed each. An empty table
    gives no rows. `place` numbers the pieces of a bin from 0.

    Rows are dealt evenly to groups of about `group_rows` rows by a hash of id and text, so a
    source or cluster with a third of all rows is spread over all groups, and a
    task holds some thousand short records, never texts. Each group leaves at
    most its own half-filled bins, a fixed share. Within a group the longest piece comes first, ties
    by doc_id, cluster and piece.
    """
    measured = df.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) if cluster is None else F.xxhash64(cluster)).alias("cluster"),
        (text_length(F.col("text")) if length is None else length.cast("bigint")).alias("length"),
    )
    groups = max(1, ceil(df.count() / group_rows))
    dealt = measured.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(groups)).cast("int"))
    kind = dict(measured.dtypes)["doc_id"]
    schema = (
        f"doc_id {kind}, piece int, n_pieces int, length bigint, offset bigint, pack_group int, bin bigint, place int"
    )

    def packed(rows: pa.Table) -> pa.Table:
        return _pack_group(rows, capacity)

    return dealt.groupBy("pack_group").applyInArrow(packed, schema).withColumnRenamed("doc_id", doc_id)


def _bits(values: pa.ChunkedArray) -> np.ndarray:
    """Bit numbers of values that occur more than once; -1 for the others and nulls, which cannot conflict."""
    codes = pc.fill_null(values.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    counts = np.bincount(codes[codes >= 0], minlength=1)
    numbers = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)
    return np.where(codes >= 0, numbers[codes], -1)


def _pack_group(rows: pa.Table, capacity: int) -> pa.Table:
    total = rows["length"].to_numpy()
    n_pieces = np.maximum(1, -(-total // capacity))
    index = np.repeat(np.arange(len(total)), n_pieces)
    piece = np.arange(len(index)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    offset = piece * capacity
    pieces = rows.take(pa.array(index)).select(["doc_id", "pack_group", "source", "cluster"])
    for name, values in (
        ("piece", piece.astype(np.int32)), ("n_pieces", n_pieces[index].astype(np.int32)),
        ("length", np.minimum(capacity, total[index] - offset)), ("offset", offset),
    ):
        pieces = pieces.append_column(name, pa.array(values))
    pieces = pieces.sort_by(
        [("length", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("piece", "ascending")]
    )
    bins = best_fit(
        pieces["length"].to_pylist(), _bits(pieces["source"]).tolist(), _bits(pieces["cluster"]).tolist(), capacity
    )
    by_bin = np.argsort(bins, kind="stable")
    firsts = np.searchsorted(bins[by_bin], bins[by_bin])
    place = np.empty(len(bins), dtype=np.int32)
    place[by_bin] = np.arange(len(bins)) - firsts
    pieces = pieces.append_column("bin", pa.array(bins)).append_column("place", pa.array(place))
    return pieces.select(["doc_id", "piece", "n_pieces", "length", "offset", "pack_group", "bin", "place"])
