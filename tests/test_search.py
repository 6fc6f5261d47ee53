"""The written search index against plain LIKE."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitelode.operators import search

NOW = datetime(2024, 5, 2, 12, 0, 0)
SITES = "site_id bigint, last_checked timestamp_ntz, title string, description string, address string, status string"


def like(pattern):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return re.compile(f".*{out}.*", re.S)


def rows(n=120, seed=5):
    rng = random.Random(seed)
    words = ["http", "shop", "Ärger", "on%off", "a_b", "night", "x", "\U0001f600z", "two words", ""]
    made = []
    for i in range(n):
        title, about = (rng.choice([None, " ".join(rng.choices(words, k=rng.randint(1, 4)))]) for _ in range(2))
        made.append((i, rng.choice([None, NOW - timedelta(days=rng.randint(0, 5))]), title, about, f"http{i:03}.onion", "active"))
    return made


def test_index_finds_what_like_finds(spark, tmp_path):
    data = rows() + [(None, None, "shop without id", None, "b.onion", "x"), (3, NOW, "repeated id", "shop", "c.onion", "x"), (500, NOW, None, None, None, None)]
    queries = [
        "http", "onion", "oni", "shop", "SHOP", "ärger", "a_b", "a\\_b", "on\\%o", "s%p", "t%n_ght", "_", "%", "__", "h", "ho", "ght x", "zzz", "zzzhttp",
        "\U0001f600", "two words", "", None, "http0%1.on", "p%h", "\\\\",
    ]
    index = search.build_search_index(spark.createDataFrame(data, SITES).repartition(3), str(tmp_path / "index"))
    wanted = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = {}
    for r in search.search_index(index, wanted, limit=1000).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.site_id))
    for i, query in enumerate(queries):
        pattern = like((query or "").lower())
        hits = [r for r in data if any(t is not None and pattern.fullmatch(t.lower()) for t in r[2:5])]
        hits.sort(key=lambda r: (r[1] is not None, -(r[1] - datetime(2000, 1, 1)).total_seconds() if r[1] else 0, r[0] is not None, r[0] or 0))
        assert [s for _, s in sorted(got.get(i, []), key=lambda x: x[0])] == [r[0] for r in hits], query


def test_a_query_meets_only_the_texts_with_its_rarest_piece(spark, tmp_path):
    data = [(i, None, "http common title", None, f"http{i:04}.onion", "x") for i in range(400)] + [(900, None, "http rareword", None, "http900.onion", "x")]
    index = search.build_search_index(spark.createDataFrame(data, SITES), str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "http%rareword"), (2, "http0123.oni"), (3, "onions")], "query_id int, query string")
    probes = {r.query_id: r for r in search.probes(index, queries).collect()}
    assert probes.keys() == {1, 2} and probes[1].n == 1 and probes[2].n < 20  # nothing holds "ons"
    met = search.candidates(index, search.probes(index, queries)).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in met} == {1: 1, 2: probes[2].n}


def test_only_the_folders_of_probed_pieces_are_read(spark, tmp_path):
    index = search.build_search_index(spark.createDataFrame(rows(), SITES), str(tmp_path / "index"))
    wanted = search.probes(index, spark.createDataFrame([(1, "night")], "query_id int, query string")).filter("part IS NOT NULL")
    one = [r.part for r in wanted.collect()]
    plan = search.candidates(index, search.probes(index, spark.createDataFrame([(1, "night")], "query_id int, query string")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text or "DynamicPruning" in text
    files = index.postings.filter(F.col("part").isin(one)).inputFiles()
    assert 0 < len({f.rsplit("/", 2)[1] for f in index.postings.inputFiles()}) <= search.PARTS and files


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SITES)
    index = search.build_search_index(empty, str(tmp_path / "index"))
    wanted = spark.createDataFrame([(1, "a"), (2, "%")], "query_id int, query string")
    assert search.search_index(index, wanted).collect() == []
    with_rows = search.build_search_index(spark.createDataFrame(rows(5), SITES), str(tmp_path / "other"))
    assert search.search_index(with_rows, wanted.limit(0)).collect() == []


@pytest.mark.parametrize("text,pieces", [("", {""}), ("a", {"", "a"}), ("aab", {"", "a", "b", "aa", "ab", "aab"})])
def test_pieces(spark, text, pieces):
    frame = spark.createDataFrame([(text,)], "t string")
    assert set(frame.select(search.pieces_of_text(F.col("t"))).first()[0]) == pieces


def test_the_index_holds_lists_and_a_probed_text_travels_once(spark, tmp_path):
    data = [(i, None, "http common title", None, f"http{i:04}.onion", "x") for i in range(400)]
    index = search.build_search_index(spark.createDataFrame(data, SITES).repartition(2), str(tmp_path / "index"))
    assert index.lists.count() * 10 < index.postings.count()
    wanted = search.probes(index, spark.createDataFrame([(i, "common t%e") for i in range(30)], "query_id int, query string"))
    assert search._probed(index, wanted).count() == 400 and search.candidates(index, wanted).count() == 30 * 400
