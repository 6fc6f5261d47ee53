"""Jaccard join on word shingles: subsets for small sets, inverted lists for large ones."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sitelode.llm.arrowtext import chain, shingle_sets, slices, sorted_inside
from sitelode.llm.common import SHINGLE_WORDS, SIMILAR_PERCENT, components
from sitelode.session import materialize

#: Share of the hash range whose shingles are counted; prefixes take a quarter of a set, so they nearly always lie in it.
COUNTED = int(0.3 * 2**64)
#: A shingle in more sets than this goes to the end of the order. At most HOT_KEYS of the commonest do; only speed depends on both.
HOT_COUNT, HOT_KEYS = 15, 1 << 19
MOST_LIGHT = 12
#: Text that a task holds as shingles at once. Numbers of a place take some 25 times its bytes.
PIECE_BYTES = 1 << 20
#: Rounds against centres go on while the pairs left would be this many times the postings, up to MOST_STARS; only speed depends on both.
CROWDED, MOST_STARS = 4, 4


def least_overlap(a: int, b: int, percent: int) -> int:
    """Shingles that sets of these sizes must share to be linked."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """So many first shingles (in one common order) hold one that any linked set has among its own first ones."""
    return n - (percent * n + 99) // 100 + 1


def overlap_sizes(n: int, percent: int) -> list[int]:
    """Overlaps that a set of size n needs with its possible partners."""
    partners = range(-(-percent * n // 100), n * 100 // percent + 1)
    return sorted({least_overlap(n, m, percent) for m in partners if least_overlap(n, m, percent) <= min(n, m)})


def light_boundary(list_length: float, percent: int) -> int:
    """Largest size up to which enumerating subsets costs no more than scanning the inverted lists of a prefix."""
    size = 0
    while size < MOST_LIGHT:
        n = size + 1
        subsets = sum(comb(n, c) for c in overlap_sizes(n, percent))
        if subsets > int(prefix_length(np.array([n]), percent)[0]) * (1 + list_length):
            break
        size = n
    return size


#: The mark of a posting is its place in the set times KINDS, plus the kind of its key in the common order, subsets before all.
KINDS = 4


def _signatures(values, offsets, hot: np.ndarray, light: int, percent: int) -> tuple[list, tuple, tuple]:
    """Fingerprint, counted prefix keys and free keys of every set, keys with their marks.

    The common order is: counted shingles that are not hot, then uncounted ones,
    then hot ones, each by hash. Keys outside the counted part are free: prefix
    shingles of the last two kinds, and subsets of small sets. In sets so small that a partner may post subsets all places count as the first.
    """
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    counted = values < np.uint64(COUNTED)
    kind = np.where(_listed(values, hot), 2, np.where(counted, 0, 1))
    order = sorted_inside(owner, values, kind)
    rank = np.arange(len(values)) - offsets[owner]
    posts = n >= ceil(percent * (light + 1) / 100)
    chosen = (rank < prefix_length(n, percent)[owner]) & posts[owner]
    picked_owner, picked, picked_kind = owner[chosen], values[order][chosen], kind[order][chosen]
    marks = (np.where(n[owner] <= 2 * MOST_LIGHT, 0, rank)[chosen] * KINDS + picked_kind + 1).astype(np.int32)
    free: list[list[int]] = [[] for _ in range(len(n))]
    free_marks: list[list[int]] = [[] for _ in range(len(n))]
    for i in np.flatnonzero((n > 0) & (n <= light)).tolist():
        members = values[offsets[i] : offsets[i + 1]]
        for size in overlap_sizes(int(n[i]), percent):
            free[i] += [int(chain(np.concatenate([[np.uint64(size)], s]), size + 1)[0]) for s in map(np.array, combinations(members, size))]
        free_marks[i] = [0] * len(free[i])
    late = picked_kind > 0
    for i, key, mark in zip(picked_owner[late].tolist(), picked[late].tolist(), marks[late].tolist()):
        free[i].append(key)
        free_marks[i].append(mark)
    counts = np.bincount(picked_owner[~late], minlength=len(n))
    prints = [xxhash.xxh3_128_digest(values[offsets[i] : offsets[i + 1]].tobytes()) for i in range(len(n))]
    return prints, (picked[~late], marks[~late], counts), (free, free_marks)


def _listed(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in an ascending list."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _signed(value: np.ndarray) -> np.ndarray:
    return value.astype(np.uint64).view(np.int64)


def _lists(flat: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)


def _hot_keys(counts: DataFrame) -> np.ndarray:
    """The commonest counted shingles above HOT_COUNT, at most HOT_KEYS: the cut is a power of two found from a histogram."""
    often = counts.filter(F.col("n") > HOT_COUNT)
    histogram = {r["power"]: r["keys"] for r in often.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("keys")).collect()}
    power, total = max(histogram, default=0) + 1, 0
    while power > 0 and total + histogram.get(power - 1, 0) <= HOT_KEYS:
        power -= 1
        total += histogram.get(power, 0)
    kept = often.filter(F.log2("n") >= power).select("key").toArrow()["key"].to_numpy()
    return np.sort(kept.view(np.uint64))


def _members(docs: DataFrame, length: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Profiles (row, doc_id, n, print) of all texts, and (key, mark, row, n) where at least two rows share a key."""
    def shingle_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most=PIECE_BYTES):
                values, _ = shingle_sets(piece.column("text"), length)
                keys, n = np.unique(values[values < np.uint64(COUNTED)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(keys)), pa.array(n)], names=["key", "n"])

    counts = materialize(
        docs.select("text").mapInArrow(shingle_keys, "key bigint, n bigint")
        .groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"),
        "shared-shingles",
    )
    hot = _hot_keys(counts)

    def lacking_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most=PIECE_BYTES):
                values, offsets = shingle_sets(piece.column("text"), length)
                n = np.diff(offsets)
                owner, counted = np.repeat(np.arange(len(n)), n), values < np.uint64(COUNTED)
                rare = np.bincount(owner[counted & ~_listed(values, hot)], minlength=len(n))
                keys, times = np.unique(values[~counted & (rare < prefix_length(n, percent))[owner]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(keys)), pa.array(times)], names=["key", "n"])

    # Sets that lack rare shingles in the counted part take others, too: these are counted over all such sets.
    others = materialize(
        docs.select("text").mapInArrow(lacking_keys, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"),
        "further-shingles",
    )
    hot = np.sort(np.concatenate([hot, _hot_keys(others)]))
    seen = counts.filter(F.col("n") <= HOT_COUNT).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("x")).first()["x"]
    light = light_boundary(seen or 1.0, percent)

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most=PIECE_BYTES):
                values, offsets = shingle_sets(piece.column("text"), length)
                prints, (keys, marks, key_counts), (free, free_marks) = _signatures(values, offsets, hot, light, percent)
                flat_free = np.fromiter((k for f in free for k in f), np.uint64)
                flat_marks = np.fromiter((m for f in free_marks for m in f), np.int32)
                free_counts = np.array([len(f) for f in free], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), pa.array(np.diff(offsets)), pa.array(prints, pa.binary()),
                        _lists(pa.array(_signed(keys)), key_counts), _lists(pa.array(marks), key_counts),
                        _lists(pa.array(_signed(flat_free)), free_counts), _lists(pa.array(flat_marks), free_counts),
                    ],
                    names=["doc_id", "n", "print", "keys", "marks", "free", "free_marks"],
                )

    signatures = materialize(
        docs.mapInArrow(
            signed, "doc_id bigint, n bigint, print binary, keys array<bigint>, marks array<int>, free array<bigint>, free_marks array<int>"
        )
        .withColumn("row", F.monotonically_increasing_id()),
        "signatures",
    )
    profiles = signatures.select("row", "doc_id", "n", "print")
    posted = ("key", "mark", "row", "n")
    counted = signatures.select("row", "n", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("marks").alias("mark")))).join(counts.select("key"), "key")
    free = signatures.select("row", "n", F.inline(F.arrays_zip(F.col("free").alias("key"), F.col("free_marks").alias("mark"))))
    shared = free.groupBy("key").agg(F.min("row").alias("_a"), F.max("row").alias("_b")).filter("_a < _b").select("key")
    return profiles, counted.select(*posted).unionByName(free.join(shared, "key").select(*posted))


def _size_fits(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _rests_reach(n: str, rest: str, other_n: str, other_rest: str, percent: int):
    """Whether what both sets hold from the place of a shingle on reaches the overlap that their sizes need."""
    return F.least(rest, other_rest) * (100 + percent) >= (F.col(n) + F.col(other_n)) * percent


def _crowded(placed: DataFrame, percent: int) -> bool:
    """Whether sets of one list, in different components, would make many more pairs than there are postings."""
    able = placed.filter(F.col("rest") * (100 + percent) >= F.col("n") * (2 * percent)).groupBy("key", "c").agg(F.count("*").cast("double").alias("sets"))
    lists = able.groupBy("key").agg(F.sum("sets").alias("all"), F.sum(F.col("sets") * F.col("sets")).alias("within"))
    pairs = lists.agg(F.sum((F.col("all") * F.col("all") - F.col("within")) / 2).alias("pairs")).first()["pairs"]
    return (pairs or 0) > CROWDED * placed.count()


def _starred(placed: DataFrame, number: int, percent: int) -> DataFrame:
    """Postings (key, row, n, c, rest) of sets that can be linked to the centre `m` of their list and are not yet in its component.

    The first centre is the set that holds most of itself from the shingle on. A change in a copy puts shingles
    before those that all copies have, so this is the least changed copy, which is linked to every copy that any
    centre could be linked to, or nearly so. Later centres are drawn by hash.
    """
    chance = F.xxhash64(F.col("row"), F.lit(number))
    by = F.struct(-F.col("rest") / F.col("n") if number == 0 else F.lit(0), chance)
    centre = placed.groupBy("key").agg(F.min_by(F.struct("row", "n", "c", "rest"), by).alias("m"))
    apart = (F.col("c") != F.col("m.c")) & _size_fits("n", "m.n", percent)
    return placed.join(centre, "key").filter(apart & _rests_reach("n", "rest", "m.n", "m.rest", percent))


def _distinct_lists(postings: DataFrame) -> DataFrame:
    """Postings (key, row, n, mark, times) with one key for all keys that have the same rows; `times` counts them.

    The shingles of a passage have nearly all the same list. Lists are the same
    when size, sum and exclusive or of the hashes of their rows are. The key that
    stays is the first in the common order, where every row has its best place.
    """
    lists = postings.groupBy("key").agg(
        F.count("*").alias("_n"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("_sum"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("_xor"),
        F.min(F.col("mark") % KINDS).alias("_kind"),
    ).filter("_n > 1")
    # keys of one kind are ordered as unsigned numbers
    earliest = F.min(F.struct("_kind", F.col("key").bitwiseXOR(F.lit(-(2**63))).alias("order"), "key"))["key"]
    kept = lists.groupBy("_n", "_sum", "_xor").agg(earliest.alias("key"), F.count("*").alias("times"))
    return postings.join(kept.select("key", "times"), "key")


def _long_enough(percent: int):
    """Whether a pair can be linked at all, from `shared`: the prefix shingles that both sets have, and the sizes.

    Whichever prefix ends earlier in the common order, all that the sets share up to there is in both prefixes,
    and after it the set has only its rest. So the shared prefix shingles and the
    larger rest bound the overlap from above. Small sets, which may post subsets, all pass.
    """
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    rest = F.ceil(F.greatest("na", "nb") * percent / 100) - 1
    return (F.least("na", "nb") <= 2 * MOST_LIGHT) | (F.col("shared") + rest >= need)


def _prefixes(postings: DataFrame) -> DataFrame:
    """(row, keys, times): the posted keys of every set, ascending, as one list; no longer than the prefix of its text."""
    listed = postings.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("key", "times"))).alias("_posted"))
    return materialize(listed.select("row", F.col("_posted.key").alias("keys"), F.col("_posted.times").alias("times")), "prefixes")


def _shared_counts(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb) with `shared`, the prefix shingles that both have.

    The two lists of a pair are compared inside its row, so there are never more rows than pairs, whatever the number of keys they share.
    """
    left = prefixes.select(F.col("row").alias("a"), F.col("keys").alias("keys_a"), F.col("times").alias("times_a"))
    right = prefixes.select(F.col("row").alias("b"), F.col("keys").alias("keys_b"))
    met = pairs.join(left, "a").join(right, "b").select("a", "na", "b", "nb", "keys_a", "times_a", "keys_b")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(name) for name in ("keys_a", "times_a", "keys_b")]
            keys_a, times_a, keys_b = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
            of_a, of_b = (np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]) for c in (lists[0], lists[2]))
            shared = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                at = slice(of_a[i], of_a[i + 1])
                shared[i] = times_a[at][_listed(keys_a[at], keys_b[of_b[i] : of_b[i + 1]])].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared)], names=["a", "na", "b", "nb", "shared"])

    n = dict(pairs.dtypes)
    return met.mapInArrow(counted, f"a bigint, na {n['na']}, b bigint, nb {n['nb']}, shared bigint")


def _ordered(met: DataFrame, row: str, n: str, other: str, other_n: str, *keep: str) -> DataFrame:
    """Pairs as (a, na, b, nb) with a < b."""
    first = F.col(row) < F.col(other)
    named = (("a", row, other), ("na", n, other_n), ("b", other, row), ("nb", other_n, n))
    return met.select(*(F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for name, x, y in named), *keep)


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, length: int, percent: int) -> DataFrame:
    """The pairs (a, b) of rows whose sets have the wanted Jaccard similarity, counted on whole sets.

    Only texts of these pairs are read again; each is found by its id and told
    from others of that id by the fingerprint of its set.
    """
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct().join(sets, "row"), "wanted-sets")
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for piece in slices(batch, most=PIECE_BYTES):
                values, offsets = shingle_sets(piece.column("text"), length)
                whole = [values[offsets[i] : offsets[i + 1]].tobytes() for i in range(piece.num_rows)]
                found = {xxhash.xxh3_128_digest(w): w for w in whole}
                new = [(k, w) for k, w in found.items() if k not in seen]
                seen.update(k for k, _ in new)
                for start in range(0, len(new), 512):
                    part = new[start : start + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _ in part], pa.binary()), pa.array([w for _, w in part], pa.binary())], names=["print", "members"]
                    )

    members = texts.mapInArrow(packed, "print binary, members binary").dropDuplicates(["print"])
    members = materialize(members, "sets")
    prints = wanted.select("row", "print")
    named = pairs.join(prints.select(F.col("row").alias("a"), F.col("print").alias("pa")), "a").join(
        prints.select(F.col("row").alias("b"), F.col("print").alias("pb")), "b"
    )
    left = named.join(members.select(F.col("print").alias("pa"), F.col("members").alias("set_a")), "pa").drop("pa")
    both = left.join(members.select(F.col("print").alias("pb"), F.col("members").alias("set_b")), "pb")

    def similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                merged = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(similar, "a bigint, b bigint")


def linked_texts(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT
) -> DataFrame:
    """Texts joined where their shingle sets have Jaccard similarity of at least `percent`.

    Returns for every row doc_id, n_shingles and component_id, the smallest doc_id reachable by
    links, itself included. Words are cut at ASCII white space, A-Z lower-cased; fewer words than
    `length` make one shingle; a text without words (or null) has an empty set
    and is linked with nothing. Rows without id take part and are named by the ids they reach, else null; rows that share an id stay
    apart unless their sets link. Repeated rows have equal sets and are linked. An empty table gives no rows.
    Other columns are not read. Ids must be integers.

    Equal sets are folded to one first. A set up to the light boundary posts all
    its subsets of every overlap size that a partner can need; larger sets post
    their prefix shingles to inverted lists, rare ones first. The boundary is
    where subsets get dearer than lists. Lists are never turned into all pairs:
    rounds check every set of a list against one centre of the list; then only
    sets of one list that are still in different components are checked with each other.
    So every link between components is found, and a large group of copies costs as
    much as it has members. A centre is the set that has changed least against its list, so few sets are left. These pairs are made only at a shingle that can be the first they share: what both
    sets hold from its place on must reach the overlap that their sizes need. So sets that have a common passage, but too
    much else to be linked, never meet, however many they are.
    """
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    profiles, raw = _members(docs, length, percent)
    full = profiles.filter("n > 0")
    first = full.groupBy("print").agg(F.min("row").alias("set"))
    of_set = materialize(full.join(first, "print").select("row", "set"), "sets-of-rows")
    sets = full.join(first.select(F.col("set").alias("row")), "row").select("row", "doc_id", "print")
    by_set = raw.join(of_set, "row").select("key", F.col("set").alias("row"), "n", "mark").distinct()
    members = materialize(by_set, "postings")
    members = materialize(_distinct_lists(members), "shared-postings")
    prefixes = _prefixes(members)
    links, checked = None, None
    component = None
    for number in range(MOST_STARS + 1):
        placed = members if component is None else members.join(
            component.select(F.col("node").alias("row"), "component"), "row", "left"
        )
        # what a set holds from the place of the shingle on
        rest = (F.col("n") - F.floor(F.col("mark") / KINDS)).alias("rest")
        placed = placed.withColumn("c", F.col("row") if component is None else F.coalesce("component", "row")).select("key", "row", "n", "c", rest)
        if component is not None:
            placed = materialize(placed, "placed")
            open_keys = placed.groupBy("key").agg(F.min("c").alias("_a"), F.max("c").alias("_b")).filter("_a < _b").select("key")
            placed = materialize(placed.join(open_keys, "key"), "open-postings")
        last = number == MOST_STARS or number > 0 and not _crowded(placed, percent)
        if not last:
            met = _starred(placed, number, percent)
            pairs = _ordered(met, "row", "n", "m.row", "m.n").distinct()
            found = _shared_counts(pairs, prefixes)
        else:
            # the smaller of a pair shares at least this with a partner of its own size
            small = placed.filter(F.col("rest") * (100 + percent) >= F.col("n") * (2 * percent)).select(
                "key", "c", F.col("row").alias("x"), F.col("n").alias("nx"), F.col("rest").alias("rest_x")
            )
            large = placed.select("key", F.col("c").alias("d"), F.col("row").alias("y"), F.col("n").alias("ny"), F.col("rest").alias("rest_y"))
            # first the components whose sizes and rests fit at all, then their sets
            of_small = small.groupBy("key", "c").agg(F.min("nx").alias("least_x"), F.max("nx").alias("most_x"), F.max("rest_x").alias("rest_x"))
            of_large = large.groupBy("key", "d").agg(F.min("ny").alias("least_y"), F.max("ny").alias("most_y"), F.max("rest_y").alias("rest_y"))
            apart = (F.col("c") != F.col("d")) & (F.col("least_x") <= F.col("most_y")) & (F.col("most_x") * 100 >= F.col("least_y") * percent)
            can = F.least("rest_x", "rest_y") * (100 + percent) >= (F.col("least_x") + F.greatest("least_x", "least_y")) * percent
            meet = of_small.join(of_large, "key").filter(apart & can).select("key", "c", "d")
            enough = _rests_reach("nx", "rest_x", "ny", "rest_y", percent)
            met = meet.join(small, ["key", "c"]).join(large, ["key", "d"]).filter((F.col("nx") <= F.col("ny")) & _size_fits("nx", "ny", percent) & enough)
            found = _shared_counts(_ordered(met, "x", "nx", "y", "ny").distinct(), prefixes)
        found = found.filter(_long_enough(percent)).select("a", "b")
        if checked is not None:
            found = found.join(checked, ["a", "b"], "left_anti")
        found = materialize(found, "candidates")
        if found.isEmpty():
            if last:
                break
            continue
        new = materialize(_verified(docs, sets, found, length, percent), "links")
        checked = found if checked is None else checked.unionByName(found)
        links = new if links is None else links.unionByName(new)
        component = components(links)
        if last:
            break
    named = profiles.join(of_set, "row", "left")
    if component is None:
        named = named.withColumn("group", F.coalesce("set", "row"))
    else:
        named = named.join(component.withColumnRenamed("node", "set"), "set", "left").withColumn(
            "group", F.coalesce("component", "set", "row")
        )
    named = materialize(named.select("doc_id", "n", "group"), "grouped")
    lowest = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return named.join(lowest, "group").select(
        F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id"
    )
