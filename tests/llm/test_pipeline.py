import random

from helpers import components, shingles
from pyspark.sql import functions as F

import corpus_pipeline
from sitelode.llm import queries, secrets
from sitelode.llm.sql import SQL

SMALL = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    flagged = {r.doc_id for r in queries.op9_toxicity(spark, SMALL).collect() if r.flagged_by_language}
    rows = {r.doc_id: r for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        path = str(tmp_path / str(number))
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if number == 4:
            break
        assert out.columns == list(corpus_pipeline.COLUMNS)
        if number == 0:
            kept = {i for i in rows if i not in flagged}
        elif number == 1:
            sets = {i: shingles(r.text) for i, r in rows.items()}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            low = components(sets, links)
            kept = {i for i in sets if low[i] == i}
        elif number == 2:
            wanted = [shingles(t) for t in items]
            kept = {i for i, r in rows.items() if not any(q and 100 * len(q & shingles(r.text)) >= 75 * len(q) for q in wanted)}
        else:
            kept = set(rows)
        got = {r.doc_id: r for r in out.collect()}
        assert got.keys() == kept, name
        if number == 3:
            spans = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
            for i, r in got.items():
                text, at = "", 0
                for s in spans[i]:
                    text += (rows[i].text[at : s.start] + "[SECRET]") if s.start >= at else ""
                    at = max(at, s.end)
                assert r.text == text + rows[i].text[at:] and r.n_chars == len(r.text)
        else:
            assert all(got[i] == rows[i] for i in kept)
        docs, rows = out, got
    placed = {r.doc_id for r in out.collect()}
    assert placed == rows.keys()


def test_run_and_registration(spark):
    from __spark_entry__ import oracle_sql
    from __spark_entry__ import queries as registered

    names = set(registered())
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(SQL) <= set(oracle_sql()) and set(SQL) <= set(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    first = {tuple(r) for r in registered()["pipeline"](spark, SMALL).collect()}
    assert first


def test_stages_bear_nulls_repeats_and_no_rows(spark):
    rng = random.Random(3)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, bin int"
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=30)), "en", "s", 5, 1, 1) for i in range(20)]
    rows += [(None, None, None, None, None, None, None), (3, None, None, "s", 0, 1, 1), rows[0], (50, "", "xx", None, 0, 1, 1), (None, "password=abcdefgh", "en", "s", 17, 1, 1)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            docs = docs if name.startswith("best") else docs.withColumn("row", F.lit(1)).withColumn("bin", F.lit(1))
        assert docs.count() >= (3 if part else 0)
