"""Substring search by a written index of short pieces: build once, probe each query by its rarest piece."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitelode.functions.layout import spread_small, top_per_group
from sitelode.session import materialize, scratch_path

GRAM = 3
PARTS = 64
SEARCHED = ("title", "description", "address")


def literal_runs(query: Column) -> Column:
    """The wildcard-free pieces of a pattern."""
    return F.filter(F.split(query, r"\\.|[%_]"), lambda r: F.length(r) > 0)


def _windows(text: Column, n: int) -> Column:
    """All runs of `n` characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))


def pieces_of_text(text: Column) -> Column:
    """The distinct pieces a pattern may probe for: the empty one, and all of 1 to GRAM characters."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[_windows(text, n) for n in range(1, GRAM + 1)]))


def pieces_of_query(query: Column) -> Column:
    """The pieces every hit contains: all of GRAM characters of its literal runs, shorter runs whole; the empty one without any."""
    whole = F.transform(literal_runs(query), lambda r: F.when(F.length(r) < GRAM, F.array(r)).otherwise(_windows(r, GRAM)))
    found = F.array_distinct(F.flatten(whole))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def _part(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(PARTS)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """A written index: `texts` (row, field, site_id, last_checked, text), `lists` (piece, field, rows) by part, `counts` (piece, n)."""

    spark: SparkSession
    path: str

    @property
    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema("piece string, field string, rows array<bigint>, part int").parquet(f"{self.path}/postings")

    @property
    def postings(self) -> DataFrame:
        """The lists row by row: (piece, field, part, row)."""
        return self.lists.select("piece", "field", "part", F.explode("rows").alias("row"))

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.schema("piece string, n bigint").parquet(f"{self.path}/counts")


def _inverted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of texts the rows that hold each piece of `pieces_of_text`, as one list per piece and field."""
    for batch in batches:
        lists: dict[tuple[str, str], list[int]] = {}
        for row, field, text in zip(*(batch.column(c).to_pylist() for c in ("row", "field", "text"))):
            pieces = {text[i : i + n] for n in range(1, GRAM + 1) for i in range(len(text) - n + 1)}
            for piece in ("", *pieces):
                lists.setdefault((piece, field), []).append(row)
        columns = [[piece for piece, _ in lists], [field for _, field in lists], list(lists.values())]
        kinds = (pa.string(), pa.string(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["piece", "field", "rows"])


def build_search_index(sites: DataFrame, path: str) -> SearchIndex:
    """Write the index of title, description and address of the sites, in lower case, under `path`.

    Rows get a number of their own, as site ids may be null or repeated. A null field has no rows. Texts are inverted
    batch by batch where they are read, so what is sorted and written is a number per piece of a text, not a row. The lists are
    dealt to PARTS folders by piece, so that a search reads only the folders of the pieces it probes. `counts` says how many texts hold a piece.
    """
    spark = sites.sparkSession
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.lower(c).alias("text")) for c in SEARCHED])
    rows = spread_small(sites.select("site_id", "last_checked", *SEARCHED), "site_id").withColumn("row", F.monotonically_increasing_id())
    texts = rows.select("row", "site_id", "last_checked", F.explode(fields).alias("f")).select("row", "site_id", "last_checked", "f.*")
    texts.filter("text IS NOT NULL").write.parquet(f"{path}/texts")
    index = SearchIndex(spark, path)
    lists = index.texts.select("row", "field", "text").mapInArrow(_inverted, "piece string, field string, rows array<bigint>")
    # the empty piece is in every text, and dealt by row so that it is no part's burden
    part = F.when(F.col("piece") == "", F.pmod(F.xxhash64(F.get("rows", F.lit(0))), F.lit(PARTS)).cast("int")).otherwise(_part(F.col("piece")))
    lists.withColumn("part", part).sortWithinPartitions("part", "piece").write.partitionBy("part").parquet(f"{path}/postings")
    index.lists.groupBy("piece").agg(F.sum(F.size("rows")).alias("n")).write.parquet(f"{path}/counts")
    return index


def probes(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """(query_id, query, has_wildcard, piece, part, n): each query with the rarest piece of its own.

    A query with a piece that no text holds has no hit and is left out. Ties go to the first piece.
    """
    lowered = queries.select("query_id", F.lower(F.coalesce("query", F.lit(""))).alias("query"))
    # queries may repeat an id; each row is probed for itself
    listed = lowered.withColumn("wanted", pieces_of_query(F.col("query")))
    exploded = listed.select("query_id", "query", F.size("wanted").alias("n_wanted"), F.explode("wanted").alias("piece"))
    known = exploded.join(index.counts, "piece").groupBy("query_id", "query", "n_wanted").agg(
        F.count_distinct("piece").alias("n_known"), F.min(F.struct("n", "piece")).alias("rarest")
    )
    rarest = known.filter("n_known = n_wanted").select("query_id", "query", "rarest.piece", "rarest.n")
    return rarest.select(
        "query_id", "query", F.col("query").rlike(r"[%_\\]").alias("has_wildcard"), "piece", "n",
        F.when(F.col("piece") != "", _part(F.col("piece"))).alias("part"),
    )


def _probed(index: SearchIndex, wanted: DataFrame) -> DataFrame:
    """(piece, row, field): the texts of the pieces that some query probes, each once however many queries do.

    The part joins, too, so that only the folders of probed pieces are read. A query of nothing but wildcards meets every text, as it has to.
    """
    probed = wanted.select("part", "piece").distinct()
    pieced = index.postings.join(probed.filter("part IS NOT NULL"), ["part", "piece"], "left_semi")
    every = index.postings.filter("piece = ''").join(probed.filter("part IS NULL"), "piece", "left_semi")
    return pieced.unionByName(every).select("piece", "row", "field")


def candidates(index: SearchIndex, wanted: DataFrame) -> DataFrame:
    """(query_id, query, has_wildcard, row, field): texts that hold the rarest piece of a query."""
    return _probed(index, wanted).join(wanted, "piece").select("query_id", "query", "has_wildcard", "row", "field")


def search_index(index: SearchIndex, queries: DataFrame, limit: int = 100) -> DataFrame:
    """The hits of a whole watch-list (query_id, query): query_id, site_id, last_checked, rank, the top `limit` per query.

    A hit is a site one of whose fields is like %query% whatever the case; last checked comes first, null before all, then
    the site id. Every query meets only the texts with its rarest piece, and the pattern decides where they meet: texts
    travel once per probed piece, and a text that is no hit leaves no row. A query with many hits sends `limit` rows per task to the ranking, not all its hits.
    """
    wanted = materialize(probes(index, queries), "probes")
    located = _probed(index, wanted).join(index.texts, ["row", "field"])
    text, like = F.col("text"), F.concat(F.lit("%"), F.col("query"), F.lit("%"))
    # the pattern is compiled per row, so plain containment of its pieces is tested first
    promising = F.forall(literal_runs(F.col("query")), lambda r: F.contains(text, r))
    hit = F.when(~F.col("has_wildcard"), F.contains(text, F.col("query"))).when(promising, F.like(text, like)).otherwise(False)
    met = located.join(wanted.withColumnRenamed("piece", "probe"), (F.col("piece") == F.col("probe")) & hit)
    found = met.groupBy("query_id", "row").agg(F.first("site_id").alias("site_id"), F.first("last_checked").alias("last_checked"))
    ranked = top_per_group(found, ["query_id"], [F.desc_nulls_first("last_checked"), F.asc("site_id")], limit)
    return ranked.select("query_id", "site_id", "last_checked", "rank")


def search_batch(sites: DataFrame, queries: DataFrame, limit: int = 100) -> DataFrame:
    """`search_sites` for a whole watch-list, over an index written for this call; see `search_index`."""
    return search_index(build_search_index(sites, scratch_path(sites.sparkSession, "search")), queries, limit)
