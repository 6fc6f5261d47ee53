import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from helpers import words
from pyspark.sql import functions as F

from sitelode.llm import mixing, prefix_trie, queries, whitening

TURNS = "conv_id bigint, turn bigint, role string, text string, id int, depth int, shard int"
DOCS = "doc_id bigint, text string, source string, size int, rate int, copy int"


# --- conversation trie -----------------------------------------------------------------

def brute_lists(rows):
    """Turns of each conversation; rows of one turn number must be equal or tell no order."""
    lists = defaultdict(list)
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if conv is not None:
            lists[conv].append((role or "", text or ""))
    return lists


def brute_trie(lists):
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in lists.items():
        ends[tuple(turns)].append(conv)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    rows = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        listed = ",".join(map(str, sorted(ends.get(path, []))))
        rows.append(
            (min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children[path]),
             sum(not children[p] for p in below), saved, hashlib.sha256(listed.encode()).hexdigest())
        )
    return sorted(rows, key=str)


def random_turns(seed, n, kinds=3, most=6):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            rows.append((conv, turn, rng.choice(["user", "bot", None]), "é" * rng.randint(0, kinds) or None, 1, 1, 1))
    return rows


@pytest.mark.parametrize("shards,fan_in", [(1, 64), (40, 3)])
def test_trie_equals_plain_prefixes_for_any_cut(spark, shards, fan_in):
    rows = random_turns(shards, 120) + [(1000 + i, t, "user", "same", 1, 1, 1) for i in range(250) for t in range(3)]
    lists = prefix_trie.turn_lists(spark.createDataFrame(rows, TURNS).repartition(5))
    got = prefix_trie.prefix_trie(lists, shards=shards, fan_in=fan_in).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(brute_lists(rows))


def test_a_long_chain_and_prefixes_of_it(spark):
    rows = [(c, t, "u", str(t % 7), 1, 1, 1) for c, n in ((-5, 400), (3, 400), (4, 399), (9, 12), (8, 1)) for t in range(n)]
    lists = prefix_trie.turn_lists(spark.createDataFrame(rows, TURNS))
    got = prefix_trie.prefix_trie(lists, shards=3, fan_in=2).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(brute_lists(rows))


def test_median_order_balances_the_tree():
    tree = prefix_trie.TernaryTree()
    for i in prefix_trie.median_order(1000):
        tree.insert([i], [1], i, 1, None)
    assert sorted(tree.walked()) == list(range(1001))
    depth, height = {tree.equal[0]: 1}, 1
    for v in tree.walked()[1:]:
        for link in (tree.less[v], tree.more[v]):
            if link >= 0:
                depth[link] = depth[v] + 1
                height = max(height, depth[link])
    assert height == 10


def test_turns_bear_nulls_repeats_and_no_rows(spark):
    rows = [
        (None, 0, "user", "lost", 1, 1, 1), (5, None, None, None, None, None, None), (5, 1, "user", "b", 1, 1, 1), (5, 1, "user", "b", 1, 1, 1),
        (6, 3, "", "", 1, 1, 1), (7, 0, "user", "x" * 100_000, 1, 1, 1), (8, 0, "a:", "b", 1, 1, 1), (9, 0, "a", ":b", 1, 1, 1),
    ]
    lists = prefix_trie.turn_lists(spark.createDataFrame(rows, TURNS))
    assert {r.conv_id: len(r.turns) for r in lists.collect()} == {5: 3, 6: 1, 7: 1, 8: 1, 9: 1}
    assert sorted(map(tuple, prefix_trie.prefix_trie(lists).collect()), key=str) == brute_trie(brute_lists(rows))
    nothing = prefix_trie.turn_lists(spark.createDataFrame([], TURNS))
    assert prefix_trie.prefix_trie(nothing).collect() == []


def test_conversation_query_rebuilds(spark, tmp_path):
    rows = [r for r in random_turns(5, 60, most=12) if r[0] % 10 or r[0] > 30]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    own = brute_lists(rows)
    rebuilt = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        rebuilt[conv] = own.get(conv - conv % 5, [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())
    got = queries.op11_conversation_trie(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rebuilt)


# --- whitening -------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, n int, x int, digest int"


def brute_whitening(rows, components=4):
    fits, out = defaultdict(set), {}
    whole = {}
    for i, (vec_id, v, *_) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v):
            x = tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)
            fits[len(x)].add(x)
            whole[i] = (vec_id, x)
    for dims, listed in fits.items():
        x = np.array(sorted(listed), dtype=object)
        n, sums = len(x), x.sum(axis=0)
        centred = np.array([[float(Fraction(n * int(a) - int(s), n)) for a, s in zip(row, sums)] for row in x])
        covariance = centred.T @ centred / n
        values, axes = np.linalg.eigh(covariance)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        for key, own in whole.values():
            if len(own) == dims:
                shifted = np.array([float(Fraction(n * a - int(s), n)) for a, s in zip(own, sums)])
                deviation = sum((n * a - int(s)) ** 2 for a, s in zip(own, sums))
                for c in range(len(values)):
                    if values[c] > 1e-9 * values[0] > 0:
                        out[key, c + 1] = (n, deviation, shifted @ axes[:, c] / np.sqrt(values[c]), values[c] / np.trace(covariance))
    return out


def check_whitening(spark, rows):
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    want = brute_whitening(rows)
    assert got.keys() == want.keys()
    signs = {}
    for at, (n, deviation, whitened, explained) in want.items():
        row = got[at]
        assert (row.n, row.deviation) == (n, deviation) and row.identity_error < 1e-9
        assert row.explained == pytest.approx(explained, rel=1e-9)
        assert abs(row.whitened) == pytest.approx(abs(whitened), abs=1e-8)
        if abs(whitened) > 1e-3:
            signs.setdefault((len(dict((r[0], r[1]) for r in rows)[at[0]]), at[1]), set()).add(row.whitened * whitened > 0)
    assert all(len(s) == 1 for s in signs.values())


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    mixed = rng.standard_normal((n, dims)) @ rng.standard_normal((dims, dims)) + 3
    return [(seed * 10_000 + i, v.tolist(), 1, 1, 1) for i, v in enumerate(mixed)]


def test_whitening_equals_a_plain_fit(spark, monkeypatch):
    rows = vectors(1, 300, 9)
    rows += [(50_000 + i, rows[0][1], 1, 1, 1) for i in range(100)]  # copies count once in the fit
    odd = [
        (60_000, None, 1, 1, 1), (60_001, [], 1, 1, 1), (60_002, [1.0] * 8 + [None], 1, 1, 1), (60_003, [float("nan")] * 9, 1, 1, 1),
        (60_004, [float("-inf")] * 9, 1, 1, 1), (60_005, [-0.0] * 9, None, None, None), (60_006, [0.0] * 9, 1, 1, 1),
        (60_007, [1.0, 2.0], 1, 1, 1), (60_008, [2.0, 5.0], 1, 1, 1),
    ]
    check_whitening(spark, rows + odd)
    # the same from many blocks in several strips
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 9 * 7)
    monkeypatch.setattr(whitening, "STRIP_BLOCKS", 20)
    check_whitening(spark, rows + odd)


def test_whitening_of_few_or_no_vectors(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, 1, 1), (2, [1.0, 2.0], 1, 1, 1)], VECTORS)).collect() == []
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0], 1, 1, 1), (None, [3.0, 4.0], 1, 1, 1)], VECTORS)).collect()
    assert sorted((r.vec_id is None, r.component, round(r.whitened, 9), round(r.explained, 9)) for r in two) == [(False, 1, -1.0, 1.0), (True, 1, 1.0, 1.0)]


def test_a_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [3e30, 1.0], 1, 1, 1), (2, [-3e30, 2.0], 1, 1, 1), (3, [5.0, 3.0], 1, 1, 1)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    # the huge entries are the largest and smallest long, whose sum is -1
    assert got == {1: None, 2: None, 3: (3 * 1280 - 1279) ** 2 + (3 * 768 - 1536) ** 2}


# --- mixing ----------------------------------------------------------------------------

def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: Fraction(left * weight[s], sum(weight[r] for r in rest)) for s in rest}
        above = {s for s in rest if share[s] >= most * sizes[s]}
        if not above:
            return {s: Fraction(most * sizes[s]) if s in full else share[s] for s in names}
        full |= above


def mixing_rows(seed=4):
    rng = random.Random(seed)
    rows, doc = [], 0
    for source, n, most in (("a", 400, 30), ("B", 5, 9), (None, 60, 20), ("ü", 1, 3), ("z", 300, 9), ("b", 900, 60), ("none", 3, 0)):
        for _ in range(n):
            rows.append((doc, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(min(1, most), most))), source, 1, 1, 1))
            doc += 1
    return rows + [(doc, None, "a", 1, 1, 1), (None, "x y", None, None, None, None), (None, "x y", None, None, None, None), (7, " q \t\x0b r" * 4000, "b", 1, 1, 1)]


def test_targets_and_copies(spark):
    rows = mixing_rows()
    df = spark.createDataFrame(rows, DOCS).drop("size")
    sized = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.draw(F.col("doc_id"), F.col("text")).alias("draw"))
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(words(text))
    want = brute_targets(sizes)
    targets = {r.source: r for r in mixing.source_targets(sized).collect()}
    assert targets.keys() == want.keys()
    for s, r in targets.items():
        assert r.source_size == sizes[s] and r.target == pytest.approx(float(want[s]), rel=1e-12) and r.target <= 3 * sizes[s]
    assert any(r.target == 3 * r.source_size > 0 for r in targets.values()) and any(0 < r.target < 3 * r.source_size for r in targets.values())
    assert sum(r.target for r in targets.values()) == pytest.approx(sum(sizes.values()))

    counted = mixing.with_copies(sized, mixing.source_targets(sized)).collect()
    assert len(counted) == len(rows) and all(int(r.rate) <= r.copies <= min(3, int(r.rate) + 1) for r in counted)
    for s in ("a", "b", "z"):
        assert sum(r.size * r.copies for r in counted if r.source == s) == pytest.approx(targets[s].target, rel=0.15)


def test_mix_emits_each_copy_and_repeats_itself(spark):
    rows = mixing_rows()
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df.repartition(3))
    assert out.columns == ["doc_id", "text", "source", "size", "rate", "copy"]
    first = sorted(map(tuple, out.collect()), key=str)
    assert first == sorted(map(tuple, mixing.mix(df.repartition(11)).collect()), key=str)
    sized = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.draw(F.col("doc_id"), F.col("text")).alias("draw"))
    copies = {r.doc_id: r.copies for r in mixing.with_copies(sized, mixing.source_targets(sized)).collect() if r.doc_id not in (None, 7)}
    got = defaultdict(list)
    for r in first:
        got[r[0]].append(r[-1])
    assert all(got.get(d, []) == list(range(1, c + 1)) for d, c in copies.items())
    other = sorted(map(tuple, mixing.mix(df, seed=21).collect()), key=str)
    assert first != other


def test_mixing_plan_is_native_and_bears_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).collect() == []
    wordless = spark.createDataFrame([(1, None, None, 1, 1, 1), (2, " \t", "a", 1, 1, 1)], DOCS)
    assert mixing.mix(wordless).collect() == []
    plan = mixing.mix(spark.createDataFrame(mixing_rows(), DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        mixing.source_targets(empty, weights=(0,))
