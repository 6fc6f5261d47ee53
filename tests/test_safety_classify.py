from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitelode.operators import classify, safety
from sitelode.operators.classify import Rule
from sitelode.plans.discovery import append_discoveries, classify_run, discovery_run
from sitelode.sources.text_lists import Pattern, pattern_parse, read_patterns, seed_parse

NOW = datetime(2024, 5, 2)
PATTERN_FILE = """# heading without number
# Category 2: Contact data
/[a-z]+@[a-z]+/i
/phone: *[0-9]+/
# Category 1: Licence
/a\\/b|license/i
"""


def test_pattern_file(spark, tmp_path):
    parsed = pattern_parse(PATTERN_FILE)
    assert parsed == [
        Pattern(2, "Contact data", "[a-z]+@[a-z]+", "i"), Pattern(2, "Contact data", "phone: *[0-9]+", "i"),
        Pattern(1, "Licence", "a\\/b|license", "i"),
    ]
    file = tmp_path / "patterns.txt"
    file.write_text(PATTERN_FILE)
    assert read_patterns(spark, str(file)) == parsed
    with pytest.raises(ValueError):
        read_patterns(spark, str(file), most=2)
    for bad, at in (("/abc", 2), ("/def/I", 2), ("bare", 2), ("/x/q", 2)):
        with pytest.raises(ValueError, match=f"line {at} "):
            pattern_parse(f"# Category 1: A\n{bad}\n")
    with pytest.raises(ValueError, match="line 1 "):
        pattern_parse("/pattern without a category/i")


def test_flags_order_counts_and_size(spark):
    frame = spark.createDataFrame(
        [("me@X and you@y LICENSE",), ("Phone: 5 phone: 6",), ("me@x " + "z" * 50,), (None,)], "text string"
    )
    got = [(r.flagged_categories, r.n_matches) for r in safety.pattern_flag(frame, pattern_parse(PATTERN_FILE)).collect()]
    assert got == [(["Licence", "Contact data"], 3), (["Contact data"], 2), (["Contact data"], 1), ([], 0)]
    big = safety.safety_check(safety.size_gate(safety.pattern_flag(frame, pattern_parse(PATTERN_FILE)), max_bytes=20).withColumns({"is_honeypot": F.lit(False), "risk_factors": F.array()}))
    assert [r.action_taken for r in big.collect()] == ["block", "block", "block", "allow"]


def test_size_is_in_bytes_and_strict(spark):
    frame = spark.createDataFrame([("é" * 5,), ("é" * 5 + "x",)], "text string")
    assert [r.over_size for r in safety.size_gate(frame, max_bytes=10).collect()] == [False, True]


def test_action_order(spark):
    frame = spark.createDataFrame(
        [(["c"], True, True, ["f"]), ([], True, True, None), (None, False, True, None), ([], None, None, ["f"]), (None, None, None, [])],
        "flagged_categories array<string>, over_size boolean, is_honeypot boolean, risk_factors array<string>",
    )
    got = [(r.action_taken, r.is_safe) for r in safety.safety_check(frame).collect()]
    assert got == [("block", False), ("quarantine", False), ("review", False), ("review", False), ("allow", True)]


def test_rules_ties_repeats_and_fallback(spark):
    rules = (Rule("market", "cart", 1.0), Rule("forum", "thread", 1.0), Rule("forum", "reply", 0.5))
    frame = spark.createDataFrame(
        [("Cart cart CART thread",), ("thread reply cart",), ("nothing",), ("",), (None,)], "text string"
    )
    got = [(r.category, round(r.confidence, 3)) for r in classify.rule_classify(frame, rules).collect()]
    assert got == [("forum", 0.5), ("forum", 0.6), ("other", 0.0), ("other", 0.0), ("other", 0.0)]


def test_gate_includes_the_threshold(spark):
    frame = spark.createDataFrame([(0.7,), (0.69,), (None,)], "confidence double")
    got = [(r.accepted, r.requires_review) for r in classify.confidence_gate(frame).collect()]
    assert got == [(True, False), (False, True), (False, True)]


def test_models(spark):
    rows = [(i, "cart price vendor buy" if i % 2 else "thread reply user post", "market" if i % 2 else "forum") for i in range(60)]
    training = spark.createDataFrame(rows, "doc_id int, text string, label string")
    model = classify.train_supervised(training)
    unseen = spark.createDataFrame([(1, "buy vendor"), (2, "post reply")], "doc_id int, text string")
    got = {r.doc_id: r for r in classify.ml_supervised(model, unseen).collect()}
    assert (got[1].category, got[2].category) == ("market", "forum") and 0.5 < got[1].confidence <= 1.0

    by_rule = spark.createDataFrame([(1, "library", 0.9), (2, "blog", 0.2), (3, "other", 0.0)], "doc_id int, category string, confidence double")
    mixed = {r.doc_id: (r.category, r.decided_by) for r in classify.hybrid_classify(by_rule, classify.ml_supervised(model, unseen)).collect()}
    assert mixed == {1: ("library", "rule_based"), 2: ("forum", "ml_supervised"), 3: ("other", "rule_based")}

    vectors = spark.createDataFrame([(i, [float(i % 2) * 9, 0.1 * i]) for i in range(20)], "vec_id int, embedding array<float>")
    clusters = {r.vec_id: r.cluster for r in classify.ml_unsupervised(vectors, k=2).collect()}
    assert {clusters[i] for i in range(0, 20, 2)}.isdisjoint({clusters[i] for i in range(1, 20, 2)})


def test_classify_run(spark):
    sites = spark.createDataFrame([("s1", None), ("s2", None), ("s3", "blog"), ("s4", None)], "site_id string, category string")
    contents = spark.createDataFrame([("s1", "vendor escrow"), ("s2", "vendor thread"), ("s3", "vendor")], "site_id string, text string")
    run = classify_run(sites, contents, NOW)
    rows = {r.site_id: (r.category, r.model_type, r.classified_at) for r in run.classifications.collect()}
    assert rows == {"s1": ("market", "rule_based", NOW), "s2": ("forum", "rule_based", NOW)}
    got = {r.site_id: (r.category, r.requires_review) for r in run.sites.collect()}
    assert got == {"s1": ("market", False), "s2": (None, True), "s3": ("blog", False), "s4": (None, False)}
    single = classify_run(sites, contents, NOW, site_id="s3")
    assert [r.site_id for r in single.classifications.collect()] == ["s3"]


def address(letter):
    return letter * 56 + ".onion"


def test_seed_lines(spark):
    lines = ["# comment", "", "   ", f"  http://{address('a')}  ", f"http://{'b' * 55}.onion", address("c") + "/x", "https://clear.org"]
    rows = seed_parse(spark.createDataFrame([(l,) for l in lines], "value string")).collect()
    assert [(r.address, r.is_valid) for r in rows] == [
        (address("a"), True), ("b" * 55 + ".onion", False), (address("c"), True), ("clear.org", False),
    ]


def test_discovery_run(spark):
    a, b, c, d, e = map(address, "abcde")
    lines = spark.createDataFrame([(f"http://{a}",), (f"http://{b}/",), ("http://bad.onion",)], "value string")
    links = [(a, f"http://{c}/{i}") for i in range(60)] + [(c, f"http://{d}/"), (d, f"http://{e}/"), (a, "http://short.onion/"), (a, "junk")]
    sites = spark.createDataFrame(
        [("1", b, NOW, "active")], "site_id string, address string, last_checked timestamp_ntz, status string"
    )
    run = discovery_run(lines, spark.createDataFrame(links, "src_address string, url string"), sites, NOW, max_depth=2)
    assert {r.address for r in run.sites.collect()} == {a, b, c, d}
    results = run.discovery_results.collect()
    assert sorted(r.discovery_method for r in results) == ["crawl", "crawl", "seed"] and {r.processing_time for r in results} == {None}
    assert {r.site_id for r in results} == {r.site_id for r in run.sites.collect()} - {"1"}
    per_site = {r[0]: r[1] for r in run.crawl_jobs.groupBy("site_id").count().collect()}
    assert sorted(per_site.values()) == [1, 1, 50]  # the seed's and d's root page, and c cut to 50 pages
    assert {(r.address, r.error) for r in run.rejected.collect()} == {
        ("bad.onion", "invalid address length"), ("short.onion", "invalid address length"),
    }


def test_discovery_run_parses_the_seeds_once(spark, tmp_path):
    a, b = address("a"), address("b")
    folder = str(tmp_path / "seeds")
    spark.createDataFrame([(f"http://{a}",), ("http://bad.onion",), (None,), ("# note",)], "value string").coalesce(1).write.parquet(folder)
    links = spark.createDataFrame([(a, f"http://{b}/1")], "src_address string, url string")
    sites = spark.createDataFrame([("1", b, NOW, "active")], "site_id string, address string, last_checked timestamp_ntz, status string")
    run = discovery_run(spark.read.parquet(folder), links, sites, NOW)
    for frame in (run.sites, run.discovery_results, run.crawl_jobs, run.rejected):
        assert not any(folder in f for f in frame.inputFiles())
    assert {r.address for r in run.rejected.collect()} == {"bad.onion"} and {r.address for r in run.sites.collect()} == {a, b}


def test_append_discoveries_defaults(spark):
    frame = spark.createDataFrame([("s1", "seed")], "site_id string, discovery_method string")
    row = append_discoveries(frame, NOW).first()
    assert (row.confidence, row.processing_time, row.source_url, row.discovered_at) == (0.0, None, None, NOW)
