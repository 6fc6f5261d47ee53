"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sitelode.llm.common import components, shuffle_partitions
from sitelode.session import materialize

COSINE = 0.93
DIMENSIONS = 8
BLOCK_ROWS = 1024
LEAF_ROWS = 128
FAN_OUT_BITS = 4
#: Vectors from which the leading directions are taken; only speed depends on them.
BASIS_ROWS = 2048


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components and a length above zero."""
    v = vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values**2).sum(axis=1, keepdims=True))


def leading_directions(distinct: DataFrame, rows: int = BASIS_ROWS) -> dict[int, np.ndarray]:
    """Principal directions for each vector length, from a bounded sample by hash; other lengths take their leading axes."""
    sample = distinct.orderBy(F.xxhash64("rep")).limit(rows).select("vector").toArrow()["vector"].combine_chunks()
    sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample
    lengths = np.array([len(v) for v in sample.to_pylist()])
    found = {}
    for length in np.unique(lengths).tolist():
        units = _matrix(sample.filter(pa.array(lengths == length)))
        _, axes = np.linalg.eigh(units.T @ units)
        found[length] = np.ascontiguousarray(axes[:, ::-1][:, :DIMENSIONS])
    return found


def _projected(units: np.ndarray, directions: dict[int, np.ndarray]) -> np.ndarray:
    axes = directions.get(units.shape[1])
    leading = units[:, :DIMENSIONS] if axes is None else units @ axes
    return np.pad(leading, ((0, 0), (0, DIMENSIONS - leading.shape[1])))


def _reach(cosine: float) -> float:
    """Distance of unit vectors at that cosine, a little widened so that rounding loses nothing."""
    return math.sqrt(2 - 2 * cosine) + 1e-9


def near_links(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two runs of the grid order with at least that cosine: the recursive interval join.

    `at_a`, `at_b` are the leading coordinates. Two intervals whose boxes are
    farther apart than the wanted distance are skipped; small ones are compared, others halved.
    """
    reach, found = _reach(cosine), []

    def join(a0: int, a1: int, b0: int, b1: int) -> None:
        gap = np.maximum(at_a[a0:a1].min(axis=0) - at_b[b0:b1].max(axis=0), at_b[b0:b1].min(axis=0) - at_a[a0:a1].max(axis=0))
        if (np.maximum(gap, 0) ** 2).sum() > reach**2:
            return
        if max(a1 - a0, b1 - b0) <= LEAF_ROWS:
            i, j = np.nonzero(a[a0:a1] @ b[b0:b1].T >= cosine)
            found.append((i + a0, j + b0))
            return
        halves_a = [(a0, a1)] if a1 - a0 <= LEAF_ROWS else [(a0, (a0 + a1) // 2), ((a0 + a1) // 2, a1)]
        halves_b = [(b0, b1)] if b1 - b0 <= LEAF_ROWS else [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)]
        for x0, x1 in halves_a:
            for y0, y1 in halves_b:
                join(x0, x1, y0, y1)

    join(0, len(a), 0, len(b))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _block_rows(batches: Iterable[pa.RecordBatch], directions: dict, most: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Cut a sorted partition into blocks of one label and vector length."""
    part, number, held = TaskContext.get().partitionId(), 0, []
    names = ["label", "dims", "rep", "copies", "vector"]

    def close() -> pa.RecordBatch:
        nonlocal number
        rows = pa.Table.from_batches(held).combine_chunks()
        vectors = rows["vector"].combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        at = _projected(_matrix(vectors), directions)
        row = {
            "label": rows["label"][0].as_py(), "dims": rows["dims"][0].as_py(), "part": part, "number": number,
            "reps": rows["rep"].to_pylist(), "copies": rows["copies"].to_pylist(),
            "vectors": vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes(),
        }
        row |= {f"lo{i}": float(x) for i, x in enumerate(at.min(axis=0))} | {f"hi{i}": float(x) for i, x in enumerate(at.max(axis=0))}
        number += 1
        held.clear()
        return pa.RecordBatch.from_pylist([row], schema=schema)

    key = None
    for batch in batches:
        batch = batch.select(names)
        keys = list(zip(batch.column("label").to_pylist(), batch.column("dims").to_pylist()))
        at = 0
        while at < len(keys):
            if held and (keys[at] != key or sum(h.num_rows for h in held) >= most):
                yield close()
            key, room = keys[at], most - sum(h.num_rows for h in held)
            to = at
            while to < len(keys) and to - at < room and keys[to] == key:
                to += 1
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield close()


def _box_distance() -> Column:
    """Squared gap of the boxes of sides a and b."""
    gaps = [
        F.greatest(F.lit(0.0), F.col(f"a.lo{i}") - F.col(f"b.hi{i}"), F.col(f"b.lo{i}") - F.col(f"a.hi{i}"))
        for i in range(DIMENSIONS)
    ]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def _near_blocks(boxes: DataFrame, reach: float, parts: int) -> DataFrame:
    """Pairs of blocks whose boxes are near, by descending a tree of intervals of the grid order.

    A node of level n covers 16^n neighbouring partitions of one label; only the
    children of near pairs meet, and they meet by an equi-join on their parents.
    """
    key = ["label", "dims"]
    merged = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(DIMENSIONS)] + [F.max(f"hi{i}").alias(f"hi{i}") for i in range(DIMENSIONS)]
    top = 0
    while parts >> (FAN_OUT_BITS * top):
        top += 1
    levels = [boxes.withColumn("node", F.struct("part", "number")).withColumn("parent", F.col("part").cast("bigint"))]
    for level in range(top + 1):
        node = F.shiftright(F.col("part").cast("bigint"), FAN_OUT_BITS * level)
        nodes = boxes.groupBy(*key, node.alias("node")).agg(*merged)
        levels.append(nodes.withColumn("parent", F.shiftright("node", FAN_OUT_BITS)))
    pairs = levels[-1].select(*key, F.col("node").alias("na"), F.col("node").alias("nb"))
    for nodes in reversed(levels[:-1]):
        a, b = nodes.alias("a"), nodes.alias("b")
        step = pairs.alias("p").join(
            a, (F.col("p.label") == F.col("a.label")) & (F.col("p.dims") == F.col("a.dims")) & (F.col("p.na") == F.col("a.parent"))
        ).join(
            b, (F.col("p.label") == F.col("b.label")) & (F.col("p.dims") == F.col("b.dims")) & (F.col("p.nb") == F.col("b.parent"))
        )
        near = step.filter((F.col("a.node") <= F.col("b.node")) & (_box_distance() <= reach**2))
        pairs = near.select("p.label", "p.dims", F.col("a.node").alias("na"), F.col("b.node").alias("nb"))
    return pairs


def _linked(rows: pa.Table, directions: dict, cosine: float, schema: pa.Schema) -> pa.Table:
    """Links between two blocks (or inside one), as counts per vector and one root per linked set."""
    sides = []
    for row in rows.sort_by([("side", "ascending")]).to_pylist():
        units = np.frombuffer(row["vectors"], np.float64).reshape(len(row["reps"]), -1)
        units = units / np.abs(units).max(axis=1, keepdims=True)
        units = units / np.sqrt((units**2).sum(axis=1, keepdims=True))
        sides.append((np.array(row["reps"], np.int64), np.array(row["copies"], np.int64), units, _projected(units, directions)))
    own = len(sides) == 1
    (ids_a, copies_a, a, at_a), (ids_b, copies_b, b, at_b) = sides[0], sides[-1]
    i, j = near_links(a, b, at_a, at_b, cosine)
    if own:
        i, j = i[i != j], j[i != j]
        ids, links = ids_a, np.bincount(i, weights=copies_a[j], minlength=len(ids_a))
    else:
        ids = np.concatenate([ids_a, ids_b])
        links = np.concatenate(
            [np.bincount(i, weights=copies_b[j], minlength=len(ids_a)), np.bincount(j, weights=copies_a[i], minlength=len(ids_b))]
        )
        j = j + len(ids_a)
    root = ids.copy()
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        if (low == root).all():
            break
        root = low
    hit = links > 0
    return pa.table([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], schema=schema)


def near_duplicates(
    df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Vectors linked when their labels are equal and their cosine is at least `cosine`.

    Returns for every row vec_id, n_links (other rows linked directly),
    component_id (smallest id reachable by links, itself included) and kept
    (it is that smallest id). Vectors that are null, zero, or hold null or non-finite
    components, rows without a label or an id, and vectors of different lengths link with nothing; a row without id has a null component
    and is not kept. Repeated rows are vectors of their own that link with each other. An empty table
    gives no rows. Other columns are not read.

    Equal vectors are first folded to one with a count. The distinct ones are
    sorted by (label, length, grid cell on the leading principal directions) and
    cut into blocks; near blocks are found by descending a tree of intervals, and
    each near pair of blocks is one small group that is joined recursively. A
    group gives at most one row per vector, never all pairs. Ids must be integers.
    """
    spark = df.sparkSession
    rows = materialize(
        df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
        .withColumn("vector", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")), F.col("vector"))),
        "vectors",
    )
    distinct = materialize(
        rows.filter(F.col("vector").isNotNull()).groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("dims", F.size("vector")),
        "distinct-vectors",
    )
    directions = leading_directions(distinct)
    reach = _reach(cosine)

    def with_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dims").to_pylist())
            cells = np.zeros((batch.num_rows, DIMENSIONS), np.int32)
            for length in np.unique(dims):
                here = dims == length
                cells[here] = np.floor(_projected(_matrix(batch.column("vector").filter(pa.array(here))), directions) / reach)
            cell = pa.ListArray.from_arrays(np.arange(len(dims) + 1, dtype=np.int32) * DIMENSIONS, cells.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=[*batch.schema.names, "cell"])

    kind = distinct.schema["label"].dataType.simpleString()
    celled = distinct.mapInArrow(with_cells, T.StructType([*distinct.schema, T.StructField("cell", T.ArrayType(T.IntegerType()))]))
    parts = shuffle_partitions(spark)
    ordered = materialize(celled, "cells").repartitionByRange(parts, "label", "dims", "cell", "rep").sortWithinPartitions("label", "dims", "cell", "rep")
    boxes = ", ".join(f"{side}{i} double" for side in ("lo", "hi") for i in range(DIMENSIONS))
    block_type = f"label {kind}, dims int, part int, number int, reps array<bigint>, copies array<bigint>, vectors binary, {boxes}"
    block_schema = to_arrow_schema(spark.createDataFrame([], block_type).schema)

    def blocks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _block_rows(batches, directions, block_rows, block_schema)

    blocks = materialize(ordered.mapInArrow(blocks_of, block_type), "blocks")
    pairs = materialize(_near_blocks(blocks.drop("reps", "copies", "vectors"), reach, parts), "block-pairs")
    payload = blocks.select(F.struct("part", "number").alias("node"), "reps", "copies", "vectors")
    sides = pairs.select("na", "nb", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("na").alias("node")), F.struct(F.lit(1).alias("side"), F.col("nb").alias("node"))
    )).alias("s")).select("na", "nb", "s.side", "s.node").filter((F.col("side") == 0) | (F.col("na") != F.col("nb")))
    together = sides.join(payload, "node").select("na", "nb", "side", "reps", "copies", "vectors")
    link_schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def linked(group: pa.Table) -> pa.Table:
        return _linked(group, directions, cosine, link_schema)

    links = materialize(together.groupBy("na", "nb").applyInArrow(linked, "rep bigint, links bigint, root bigint"), "links")
    component = components(links, "rep", "root")
    per_rep = (
        distinct.join(links.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(component.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label", "vector",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = rows.join(per_rep, ["label", "vector"], "left")
    return out.select(
        F.col("vec_id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
