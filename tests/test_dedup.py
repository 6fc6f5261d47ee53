import hashlib
import random
import re
from collections import Counter
from datetime import datetime
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sitelode.operators import dedup

NOW = datetime(2024, 5, 2)


def plain_simhash(text):
    counts = Counter(re.findall("[a-z]+", text.lower()))
    total = sum(counts.values())
    value = 0
    for bit in range(60):
        ones = sum(n for w, n in counts.items() if int(hashlib.md5(w.encode()).hexdigest()[:15], 16) >> bit & 1)
        if 2 * ones > total:
            value |= 1 << bit
    return value


def test_simhash_equals_plain_rule(spark):
    texts = ["one", "one two", "The cat the CAT the dog", "", None, "123", "a b c d e f g a a a"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.simhash for r in dedup.text_simhash(frame).collect()}
    assert got == {i: plain_simhash(t) for i, t in enumerate(texts) if t and re.search("[a-z]", t.lower())}


def near_by_hand(hashes):
    found = set()
    for (i, a), (j, b) in combinations(sorted(hashes.items()), 2):
        distance = (a ^ b).bit_count()
        if 0 < distance <= 3:
            found.add((i, j, distance))
    return found


@pytest.mark.parametrize("hot_bucket", [1000, 12, 3, 1])
def test_near_dups_equal_brute_force_whatever_is_split(spark, hot_bucket):
    rng = random.Random(11)
    values = set()
    for _ in range(12):  # clouds around centres, which crowd single bands
        centre = rng.getrandbits(60)
        for _ in range(30):
            value = centre
            for bit in rng.sample(range(60), rng.randrange(5)):
                value ^= 1 << bit
            values.add(value)
    shared = rng.getrandbits(15)
    values |= {(rng.getrandbits(45) << 15) | shared for _ in range(60)}
    hashes = dict(enumerate(sorted(values, key=lambda v: hashlib.md5(str(v).encode()).hexdigest())))
    groups = spark.createDataFrame([(v, i, 1) for i, v in hashes.items()], "simhash bigint, rep bigint, n bigint")
    rows = [(r.rep_a, r.rep_b, r.distance) for r in dedup.near_dups(groups, hot_bucket=hot_bucket).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == near_by_hand(hashes)


def test_copies_stand_behind_one_representative(spark):
    texts = ["alpha beta"] * 5 + ["gamma delta epsilon"] * 2 + ["zeta"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    hashes = dedup.text_simhash(frame)
    groups = dedup.simhash_groups(hashes)
    assert {(r.rep, r.n) for r in groups.collect()} == {(0, 5), (5, 2), (7, 1)}
    assert {r.doc_id: r.rep for r in dedup.near_dup_members(hashes, groups).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 5, 7: 7}
    assert {(r.first_id, r.n) for r in dedup.exact_dups(frame).collect()} == {(0, 5), (5, 2)}
    assert dedup.exact_dup_members(frame).count() == 7


def test_pairs_keep_their_group_sizes(spark):
    groups = spark.createDataFrame([(5, 20, 3), (4, 10, 7)], "simhash bigint, rep bigint, n bigint")
    assert dedup.near_dups(groups).first()[:] == (10, 20, 1, 7, 3)


def test_hash_upsert_newest_wins(spark):
    kind = "id int, site_id int, hash_type string, hash_value string, created_at timestamp_ntz"
    current = spark.createDataFrame([(1, 1, "title", "old", NOW), (2, 2, "title", "keep", NOW)], kind)
    incoming = spark.createDataFrame([(3, 1, "title", "new", NOW), (4, 1, "document", "d", NOW)], kind)
    got = {(r.site_id, r.hash_type): r.hash_value for r in dedup.hash_upsert(current, incoming).collect()}
    assert got == {(1, "title"): "new", (2, "title"): "keep", (1, "document"): "d"}


def test_the_rows_of_the_bands_do_not_pass_through_the_driver(spark, tmp_path):
    path = str(tmp_path / "groups")
    spark.range(50).select(F.xxhash64("id").alias("simhash"), F.col("id").alias("rep"), F.lit(1).cast("bigint").alias("n")).write.parquet(path)
    pairs = dedup.near_dups(spark.read.parquet(path))
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()
