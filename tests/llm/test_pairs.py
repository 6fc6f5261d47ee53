import random
import tracemalloc

import numpy as np
import pyarrow as pa
from helpers import components, shingles, words
from pyspark.sql import functions as F

from sitelode.llm import arrowtext, common, decontaminate, ego_join, ngram_join

VECTORS = "vec_id bigint, embedding array<float>, label int"
DOCS = "doc_id bigint, text string"


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, None)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, **{200 + i: 100 for i in range(50)}}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_send_no_rows_through_the_driver(spark):
    edges = spark.createDataFrame([(5, 1), (5, 2), (7, 5)], "u bigint, v bigint")
    star = common._small_star(common._large_star(edges))
    assert "Broadcast" not in star._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in star.collect()} == {(2, 1), (5, 1), (7, 1)}


def test_components_write_short_plans_and_stop_at_stars(spark, monkeypatch):
    written = []

    def noted(df, label="step"):
        written.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return materialize(df, label)

    materialize = common.materialize
    monkeypatch.setattr(common, "materialize", noted)
    stars = spark.createDataFrame([(1, i) for i in range(2, 9)] + [(20, 30), (20, 31)], "a bigint, b bigint")
    assert {r.node: r.component for r in common.components(stars).collect()} == {**{i: 1 for i in range(1, 9)}, 20: 20, 30: 20, 31: 20}
    assert len(written) == 1  # stars around their smallest nodes need no round
    links = [(9, i) for i in range(1, 9)] + [(9, 12), (12, 13), (40, 41)]
    low = {**{i: 1 for i in (*range(1, 10), 12, 13)}, 40: 40, 41: 40}
    assert {r.node: r.component for r in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()} == low
    assert max(written) <= 4  # a large star and a small star in one plan had 11


def brute_vectors(rows):
    usable = {}
    for i, (vec_id, v, label) in enumerate(rows):
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        a = np.array(v, np.float32).astype(np.float64)
        usable[i] = (label, a / np.linalg.norm(a))
    links = [
        (i, j) for i in usable for j in usable
        if i < j and usable[i][0] == usable[j][0] and len(usable[i][1]) == len(usable[j][1]) and usable[i][1] @ usable[j][1] >= 0.93
    ]
    return links


def check_vectors(spark, rows, **options):
    links = brute_vectors(rows)
    low = components(range(len(rows)), links)
    want = []
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in low if low[j] == low[i]]
        component = None if vec_id is None else min(ids)
        want.append((vec_id, sum(i in link for link in links), component, vec_id is not None and vec_id == component))
    got = ego_join.near_duplicates(spark.createDataFrame(rows, VECTORS).withColumn("rep", F.lit("x")), **options).collect()
    order = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(25):
        centre = rng.standard_normal(12)
        rows += [(centre + rng.standard_normal(12) * s).tolist() for s in (0, 0, 0.05, 0.1, 0.2, 0.3)]
    rows = [(i * 3 % 997, v, int(rng.integers(0, 2))) for i, v in enumerate(rows)]
    odd = [
        (5001, None, 1), (5002, [0.0] * 12, 1), (5003, [float("nan")] + [1.0] * 11, 1), (5004, [None] + [1.0] * 11, 1),
        (5005, [float("inf")] * 12, 1), (5006, rows[0][1], None), (None, rows[0][1], rows[0][2]), (5007, [1.0, 0.0], 1),
        (5008, [0.99, 0.01], 1), (5009, [], 1), (5010, [3e38] * 12, 0), (5011, [1e-30] * 12, 0), (rows[4][0], rows[4][1], rows[4][2]),
    ]
    check_vectors(spark, rows + odd, block_rows=16)


def test_one_hot_vector_and_empty_vectors(spark):
    check_vectors(spark, [(i, [1.0, 2.0, 3.0], 4) for i in range(300)] + [(300 + i, [1.0, 2.0, 3.0 + i / 100], 4) for i in range(40)], block_rows=32)
    assert ego_join.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def brute_texts(rows):
    sets = [shingles(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    low = components(range(len(rows)), links)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[low[i]] = min(ids.get(low[i], doc_id), doc_id)
    return sorted(((d, len(sets[i]), ids.get(low[i])) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed, families=12, members=10):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    rows = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice([5, 6, 8, 9, 11, 14, 30, 80, 200]))
        for _ in range(members):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                text = text + passage
            if rng.random() < 0.2:
                text = text[: -rng.randrange(1, 4)]
            rows.append((len(rows) * 7 % 10007, " ".join(text)))
    return rows


def test_linked_texts_equal_all_pairs(spark):
    for seed in (1, 2):
        rows = near_copies(seed) + [
            (20001, None), (20002, ""), (20003, " \n\t "), (20004, "one two"), (20005, "One  TWO"), (20006, "one"), (None, "one two"), (None, "alone here"), (20004, "one two"),
            (20007, "a b c d e f g h"), (20008, "A b\tc d e f g h "), (20009, "É b c d e f"), (20010, "é b c d e f"), (20011, "long " * 3000),
        ]
        df = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1)).withColumn("key", F.lit(2))
        got = ngram_join.linked_texts(df).collect()
        assert sorted(map(tuple, got), key=str) == brute_texts(rows)


def test_texts_around_a_passage_link_by_their_sizes(spark):
    """Many texts share a passage; only pairs whose own parts are short enough are linked, whatever list they meet in."""
    rng = random.Random(6)
    passage = ["p%d" % i for i in range(70)]
    rows = []
    for i in range(90):
        own = ["u%d_%d" % (i, k) for k in range(rng.randrange(2, 40))]
        cut = rng.randrange(0, 12)
        rows.append((i, " ".join(own[: len(own) // 2] + passage[: 70 - cut] + own[len(own) // 2 :])))
    want = brute_texts(rows)
    assert 20 < len({c for _, _, c in want}) < 90
    assert sorted(map(tuple, ngram_join.linked_texts(spark.createDataFrame(rows, DOCS)).collect()), key=str) == want


def test_a_group_of_near_copies_is_checked_against_its_least_changed_text(spark, monkeypatch):
    rng = random.Random(11)
    base = ["b%d" % i for i in range(150)]
    rows = []
    for i in range(240):
        text = list(base)
        for at in rng.sample(range(150), i % 9):
            text[at] = "own%d_%d" % (i, at)
        rows.append((1000 - i, " ".join(text)))
    checked = []

    def noted(docs, sets, pairs, *options):
        checked.append(pairs.count())
        return verified(docs, sets, pairs, *options)

    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", noted)
    want = brute_texts(rows)
    assert sorted(map(tuple, ngram_join.linked_texts(spark.createDataFrame(rows, DOCS)).collect()), key=str) == want
    assert sum(checked) <= 2 * len(rows)


def test_groups_without_a_common_centre_take_more_rounds(spark, monkeypatch):
    """Every text has changes of its own; the first centre reaches only some."""
    monkeypatch.setattr(ngram_join, "CROWDED", 0)
    rng = random.Random(12)
    base = ["b%d" % i for i in range(80)]
    rows = []
    for i in range(60):
        text = list(base)
        for at in rng.sample(range(10, 30), 1 + i % 3):
            text[at] = "own%d_%d" % (i, at)
        rows.append((i, " ".join(text)))
    want = brute_texts(rows)
    assert 1 < len({c for _, _, c in want}) < 60
    assert sorted(map(tuple, ngram_join.linked_texts(spark.createDataFrame(rows, DOCS)).collect()), key=str) == want


def test_linked_texts_with_all_shingles_hot(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_COUNT", 2)
    rows = near_copies(5, families=6, members=14)
    assert sorted(map(tuple, ngram_join.linked_texts(spark.createDataFrame(rows, DOCS)).collect()), key=str) == brute_texts(rows)
    assert ngram_join.linked_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_shared_prefixes_are_counted_without_a_row_for_each_key(spark):
    posted = [(key, row, 1 + key % 3) for row in range(40) for key in range(-30, 30) if (key + row) % 7]
    pairs = [(i, 60, j, 61) for i in range(0, 40, 3) for j in range(i + 1, 40, 5)]
    frame = spark.createDataFrame(pairs, "a bigint, na bigint, b bigint, nb bigint")
    prefixes = ngram_join._prefixes(spark.createDataFrame(posted, "key bigint, row bigint, times bigint"))
    counted = ngram_join._shared_counts(frame, prefixes)
    times = {(key, row): n for key, row, n in posted}
    keys = {row: {k for k, r, _ in posted if r == row} for row in range(40)}
    assert {tuple(r) for r in counted.collect()} == {(a, na, b, nb, sum(times[k, a] for k in keys[a] & keys[b])) for a, na, b, nb in pairs}
    joins = [line for line in counted._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 2 and not any("key#" in line for line in joins)  # one row a pair through both


def test_a_task_holds_few_texts_as_shingles_at_once():
    rng = random.Random(3)
    texts = pa.array([" ".join(rng.choices(["w%d" % i for i in range(3000)], k=300)) for _ in range(2000)])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    tracemalloc.start()
    for piece in arrowtext.slices(batch, most=ngram_join.PIECE_BYTES):
        arrowtext.shingle_sets(piece.column("text"), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * 1_000_000  # 43 MB with pieces of 4 MB


def test_light_boundary_follows_the_cost():
    assert ngram_join.light_boundary(0.0, 75) < ngram_join.light_boundary(50.0, 75)
    for n in range(1, 40):
        for m in range(-(-75 * n // 100), n * 100 // 75 + 1):
            assert ngram_join.least_overlap(n, m, 75) == min(c for c in range(n + m + 1) if 100 * c >= 75 * (n + m - c))


def test_contained_items_equal_a_plain_search(spark):
    rng = random.Random(9)
    vocabulary = ["v%d" % i for i in range(50)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 8, 14, 30])))) for i in range(20)] + [(90, "x y"), (93, "v1"), (94, "v2 v3 v4"), (91, None), (92, ""), (None, "n1 n2 n3 n4 n5 n6"), (3, "again a b c d e f")]
    docs = []
    for k in range(60):
        w = rng.choices(vocabulary, k=rng.choice([0, 3, 50, 400]))
        if k % 3 == 0:
            part = (items[rng.randrange(20)][1]).upper().split(" ")
            part = part[: len(part) - rng.choice([0, 0, 1, 2, 4])]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((k, "\n ".join(w)))
    docs += [(100, "X  y"), (102, "q " * 50 + "X\ty " + "q " * 50), (103, "a x y"), (104, "x q y"), (105, "v2 v3 v4 v5"), (101, None), (None, "n1 n2 n3 n4 n5 n6 n7"), (0, docs[3][1])]
    per_doc, per_item = {}, {}
    for d, t in docs:
        per_doc.setdefault(d, set()).update(shingles(t))
        for short in (1, 2, 3):  # the lengths of short items
            if len(words(t)) > short:
                per_doc[d].update(shingles(t, short))
    for i, t in items:
        per_item.setdefault(i, set()).update(shingles(t))
    want = {(d, i, len(q), len(s & q)) for d, s in per_doc.items() for i, q in per_item.items() if q and 100 * len(s & q) >= 75 * len(q)}
    assert len(want) > 10 and {(102, 90, 1, 1), (103, 90, 1, 1), (105, 94, 1, 1)} <= want and not any(d == 104 and i == 90 for d, i, *_ in want)
    a = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.contained_items(a, b).collect()
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_common) for r in got} == want and len(got) == len(want)
    kept = decontaminate.decontaminated(a, b).collect()
    hit = {d for d, *_ in want}
    assert sorted((r.doc_id for r in kept), key=str) == sorted((d for d, _ in docs if d not in hit), key=str)
    assert decontaminate.contained_items(a.limit(0), b).count() == 0 and decontaminate.contained_items(a, b.limit(0)).count() == 0
