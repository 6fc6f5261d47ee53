"""Benchmark decontamination: containment search of short items inside long documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitelode.llm.common import SHINGLE_WORDS, SIMILAR_PERCENT, words_of
from sitelode.session import materialize


def _shingles(df: DataFrame, keep: list[str], text: str, hashed: bool, out: str, shorter: Sequence[int] = ()) -> DataFrame:
    """One row per shingle position: a hash, or the shingle itself; a text of fewer words is one shingle.

    Runs of the `shorter` lengths are given as well, where a text has more words than they.
    """
    words = df.select(*keep, words_of(F.col(text)).alias("_words")).filter(F.size("_words") > 0)

    def runs(length: int, rows: DataFrame) -> DataFrame:
        placed = rows.select(*keep, "_words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_words") - length, F.lit(0)))).alias("_at"))
        parts = [F.get(F.col("_words"), F.col("_at") + i) for i in range(length)]
        return placed.select(*keep, (F.xxhash64(*parts) if hashed else F.concat_ws(" ", *parts)).alias(out))

    every = runs(SHINGLE_WORDS, words)
    for length in shorter:
        every = every.unionByName(runs(length, words.filter(F.size("_words") > length)))
    return every


def size_class(size: Column) -> Column:
    """Size partition of a shingle count: its power of two."""
    return F.floor(F.log2(size)).cast("int")


def sketch_size(size: Column, percent: int = SIMILAR_PERCENT) -> Column:
    """Number of MinHash values that an item needs: any document with the needed share of its shingles has one of them."""
    return size - F.ceil(size * percent / 100).cast("bigint") + 1


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    percent: int = SIMILAR_PERCENT,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains: at least `percent` of the item's distinct shingles.

    Returns doc_id, item_id, size_class, n_shingles (of the item), n_common. Shingles
    are five words, A-Z lower-cased; an item or document with fewer words is one
    shingle, one without words has none and is in no pair. An item of one to four words is contained where its words
    stand in this order, at any place of a text: documents give runs of the lengths of such items, too. Null texts count as
    empty. Rows with a null id are searched like others; rows that share an id
    are one text with all their shingles, so repeated rows give one pair. Empty tables give no
    pairs. Other columns are not read.

    Items are split by size. The sketch of an item is its smallest shingle hashes,
    as many as its size needs so that no document with the wanted share can miss
    all of them (a fixed-length sketch would lose short items in long documents,
    where the Jaccard similarity is tiny). Documents meet the sketches by an equi-join on the hash;
    Spark broadcasts the sketches when their written size allows it and shuffles otherwise. Only
    the documents found are read again, and their pairs are decided on the
    shingles themselves. No document is ever collected with others into one group.
    """
    item = items.select(F.col(item_id).alias("_item"), F.col(text).alias("_text"))
    sizes_below = item.select(F.size(words_of(F.col("_text"))).alias("n")).filter((F.col("n") > 0) & (F.col("n") < SHINGLE_WORDS)).distinct()
    shorter = sorted(r.n for r in sizes_below.collect())  # four lengths at most
    wanted = materialize(
        _shingles(item, ["_item"], "_text", False, "_shingle").distinct(), "item-shingles"
    )
    sizes = wanted.groupBy("_item").agg(F.count("*").alias("n_shingles"))
    ranked = _ranked(wanted.withColumn("_hash", F.xxhash64(*[F.get(F.split("_shingle", " "), F.lit(i)) for i in range(SHINGLE_WORDS)])))
    sketch = materialize(
        ranked.join(sizes, ranked["_item"].eqNullSafe(sizes["_item"]))
        .filter(F.col("_rank") <= sketch_size(F.col("n_shingles"), percent))
        .select(ranked["_item"], "_hash", size_class(F.col("n_shingles")).alias("size_class")),
        "item-sketches",
    )
    doc = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    hashes = _shingles(doc, ["_doc"], "_text", True, "_hash", shorter)
    found = materialize(
        hashes.join(sketch, "_hash").select("_doc", "_item", "size_class").distinct(), "candidates"
    )
    known = found.select("_doc").distinct().withColumnRenamed("_doc", "_known")
    texts = doc.join(known, doc["_doc"].eqNullSafe(known["_known"]), "left_semi")
    exact = _shingles(texts, ["_doc"], "_text", False, "_shingle", shorter).distinct()
    per_item = wanted.join(sizes.withColumnRenamed("_item", "_of"), wanted["_item"].eqNullSafe(F.col("_of"))).drop("_of")
    common = (
        exact.join(per_item, "_shingle").groupBy("_doc", "_item", "n_shingles").agg(F.count("*").alias("n_common"))
        .filter(F.col("n_common") * 100 >= F.col("n_shingles") * percent)
    )
    pair = found.select(F.col("_doc").alias("_d"), F.col("_item").alias("_i"), "size_class")
    same = common["_doc"].eqNullSafe(F.col("_d")) & common["_item"].eqNullSafe(F.col("_i"))
    return common.join(pair, same).select(
        F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), "size_class", "n_shingles", "n_common"
    )


def _ranked(shingles: DataFrame) -> DataFrame:
    """Shingle hashes of each item ranked from the smallest; an item is a short text, so one group is small."""
    from pyspark.sql import Window

    return shingles.withColumn("_rank", F.row_number().over(Window.partitionBy("_item").orderBy("_hash", "_shingle")))


def decontaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that contain no benchmark item, with all their columns. Rows with a null id go when a null-id text has a hit."""
    hits = contained_items(docs, items, doc_id=doc_id, **options).select(F.col(doc_id).alias("_hit")).distinct()
    return docs.join(hits, docs[doc_id].eqNullSafe(hits["_hit"]), "left_anti")
