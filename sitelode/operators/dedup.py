"""Exact and near duplicates by content hash and 60-bit similarity hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitelode.functions.layout import spread_small
from sitelode.functions.scalars import content_hash, words
from sitelode.session import materialize

BITS = 60
HALF = BITS // 2
HASH_HEX = 15  # 15 hex digits of md5 are 60 bits
MAX_DISTANCE = 3
BANDS = MAX_DISTANCE + 1  # three different bits cannot touch all four bands
HOT_BUCKET = 1000
SPLITS = 5  # bands of 15, 11, 8, 6 and 5 bits


def exact_dups(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(content_hash, first_id, n) for content held by more than one row."""
    return (
        documents.select(key, content_hash(text).alias("content_hash"))
        .groupBy("content_hash")
        .agg(F.min(key).alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
    )


def exact_dup_members(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, first_id) for every row whose content occurs more than once; contents are read and hashed once."""
    hashed = materialize(documents.select(key, content_hash(text).alias("content_hash")), "content-hashes")
    groups = hashed.groupBy("content_hash").agg(F.min(key).alias("first_id"), F.count("*").alias("n"))
    return hashed.join(groups.filter("n > 1"), "content_hash").select(key, "first_id")


def text_simhash(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, simhash): bit i is 1 when it is set in more than half of the words.

    Two bit counts share one long: bit j in the low half, bit j+30 in the high
    half. A count stays below 2^30, the longest word list a string can hold, so
    the halves never run into each other. Texts without a word have no row.
    """
    word = spread_small(documents.select(key, text), key).select(key, F.explode(words(text)).alias("word"))
    number = F.conv(F.substring(F.md5("word"), 1, HASH_HEX), 16, 10).cast("bigint")
    pair, low_half = 1 | (1 << HALF), (1 << HALF) - 1
    counts = [F.expr(f"sum(shiftrightunsigned(h, {j}) & {pair}L)").alias(f"s{j}") for j in range(HALF)]
    sums = word.select(key, number.alias("h")).groupBy(key).agg(F.count("*").alias("n"), *counts)
    bits = [f"if(2 * (s{j} & {low_half}L) > n, {1 << j}L, 0L)" for j in range(HALF)]
    bits += [f"if(2 * shiftrightunsigned(s{j}, {HALF}) > n, {1 << (j + HALF)}L, 0L)" for j in range(HALF)]
    return sums.select(key, F.expr(" + ".join(bits)).alias("simhash"))


def simhash_groups(hashes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(simhash, rep, n): rows with equal hash stand behind one representative."""
    return hashes.groupBy("simhash").agg(F.min(key).alias("rep"), F.count("*").alias("n"))


def near_dup_members(hashes: DataFrame, groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rep) for every hashed row; with `near_dups` this gives all near pairs."""
    return hashes.join(groups, "simhash").select(key, "rep")


def _band(value: Column, index: int, width: int) -> Column:
    return F.shiftrightunsigned(value, index * width).bitwiseAND(F.lit((1 << width) - 1))


def _without_band(value: Column, index: int, width: int) -> Column:
    """`value` with the bits of one band cut out and the rest pushed together."""
    low = value.bitwiseAND(F.lit((1 << (index * width)) - 1))
    high = F.shiftrightunsigned(value, (index + 1) * width)
    return F.shiftleft(high, index * width) + low


def near_dups(groups: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs of groups (from `simhash_groups`) whose hashes differ in 1 to 3 bits.

    Works on distinct hashes, so copies never pair with each other. Two hashes at
    most 3 bits apart agree in one of four bands and meet in that band's bucket.
    A bucket with more than `hot_bucket` hashes is split by the same argument on
    the remaining bits. A pair is kept only in the first band in which it agrees,
    so none is found twice and no distinct is needed. After the last split a
    bucket shares 45 bits: it cannot hold more than 2^15 hashes.

    Give written groups (`materialize`): they are read once per split.
    """
    entries = groups.select("simhash", "rep", "n", F.col("simhash").alias("rest0"))
    keys: list[str] = []
    widths: list[int] = []
    left = BITS
    found = None
    for level in range(SPLITS):
        width = left // BANDS
        rest, band, value = f"rest{level}", f"band{level}", f"value{level}"
        bands = F.array(*[_band(F.col(rest), i, width) for i in range(BANDS)])
        entries = entries.select("*", F.posexplode(bands).alias(band, value))
        keys += [band, value]
        widths.append(width)
        left -= width
        settled, crowded = entries, None
        if level < SPLITS - 1:
            sizes = entries.groupBy(*keys).agg(F.count("*").alias("_size"))
            crowded = materialize(sizes.filter(F.col("_size") > hot_bucket).drop("_size"), "crowded")
            if crowded.isEmpty():
                crowded = None
            else:
                settled = entries.join(crowded, keys, "left_anti")
        pairs = _bucket_pairs(settled, keys, widths)
        found = pairs if found is None else found.unionByName(pairs)
        if crowded is None:
            break
        cut = F.coalesce(*[F.when(F.col(band) == i, _without_band(F.col(rest), i, width)) for i in range(BANDS)])
        entries = entries.join(crowded, keys, "left_semi").withColumn(f"rest{level + 1}", cut)
    return found


def _bucket_pairs(entries: DataFrame, keys: list[str], widths: list[int]) -> DataFrame:
    """Near pairs inside each bucket that do not agree in an earlier band of any level."""
    a, b = entries.alias("a"), entries.alias("b")
    meets = F.col("a.simhash") < F.col("b.simhash")
    for key in keys:
        meets = meets & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    apart = F.bit_count(F.col("a.simhash").bitwiseXOR(F.col("b.simhash")))
    near = apart <= MAX_DISTANCE
    for level, width in enumerate(widths):
        diff = F.col(f"a.rest{level}").bitwiseXOR(F.col(f"b.rest{level}"))
        for i in range(BANDS - 1):
            near = near & ((F.col(f"a.band{level}") <= i) | (_band(diff, i, width) != 0))
    in_order = F.col("a.rep") < F.col("b.rep")
    # the size check sees the groups, not the rows of their bands: a broadcast would take many times what it allows through the driver
    return a.join(b.hint("merge"), meets & near).select(
        F.least("a.rep", "b.rep").alias("rep_a"),
        F.greatest("a.rep", "b.rep").alias("rep_b"),
        apart.alias("distance"),
        F.when(in_order, F.col("a.n")).otherwise(F.col("b.n")).alias("n_a"),
        F.when(in_order, F.col("b.n")).otherwise(F.col("a.n")).alias("n_b"),
    )


def hash_upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One hash per (site_id, hash_type): the newest, by created_at then id."""
    both = current.unionByName(incoming, allowMissingColumns=True)
    keys = ["site_id", "hash_type"]
    keep = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct("created_at", "id")).alias("row"))
    return newest.select(*keys, "row.*")
