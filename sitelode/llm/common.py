"""What several operators share: reading, words, partition counts, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitelode.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space between words: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 75


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Words of a text as an array: A-Z lower-cased, cut at ASCII white space; null gives none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SPACES, -1), "")


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components: one row (node, component) for every node of `edges`.

    The component is its smallest node. Edges with a null end and loops are
    ignored. Large-star and small-star steps alternate until the edges are stars
    around smallest nodes; every step is an aggregate with map-side minima and a merge join, and
    its edges are written, so no component meets in one task, plans stay short and lineage ends.
    """
    a, b = F.col(left), F.col(right)
    now = materialize(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _settled(now):
        larger = materialize(_large_star(now), "edges")
        now = materialize(_small_star(larger), "edges")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(edges: DataFrame) -> bool:
    """Whether every upper end has one edge and is no lower end."""
    upper = F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    lower = F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = edges.select(F.inline(F.array(upper, lower))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's smallest neighbour (or itself); an edge has its larger end in u."""
    there, back = F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    lowest = edges.select(F.inline(F.array(there, back))).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = edges.select(F.col("v").alias("u"), F.col("u").alias("above")).join(lowest.hint("merge"), "u")
    kept = joined.select(F.col("above").alias("u"), F.col("m").alias("v"))
    return kept.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and the neighbours below it are linked to the smallest of these."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest.hint("merge"), "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = lowest.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).distinct()
