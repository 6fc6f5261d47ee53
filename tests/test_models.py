"""Language profiles, naive Bayes and calibration against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sitelode.operators import bayes, calibrate, language
from sitelode.plans.registry import all_queries

WORD = re.compile(r"[^\W\d_]+")
TEXTS = {
    "en": "the quick weather changes with every wind that brings the night",
    "de": "der schnelle Wetterwechsel bringt mit jedem Wind die dunkle Nacht über",
    "fr": "le temps change vite avec chaque vent qui apporte la nuit noire",
}


def plain_features(text):
    found = WORD.findall((text or "").lower())
    names = [f"^{w[:3]}" for w in found] + [f"{w[-3:]}$" for w in found]
    return [zlib.crc32(n.encode()) % language.BUCKETS for n in names]


def documents(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string")


def training(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(t.split(), k=30)), lang) for lang, t in TEXTS.items() for _ in range(8)]
    return documents(spark, rows + [(None, "en"), ("unknown words", None), ("", "de"), ("12 34 ..", "fr")]), rows


def test_profile_counts_word_edges(spark):
    df, rows = training(spark)
    got = {(r.lang, r.bucket): r.n for r in language.language_counts(df).collect()}
    want = Counter((lang, b) for text, lang in rows for b in plain_features(text))
    assert got == dict(want)


def test_detection_equals_plain_bayes_and_leaves_open_what_is_unclear(spark, tmp_path):
    df, rows = training(spark)
    counts = language.language_counts(df)
    counts.write.parquet(str(tmp_path / "profile"))
    model = language.LanguageModel.from_counts(spark.read.parquet(str(tmp_path / "profile")))
    assert list(model.weights) == sorted(TEXTS)
    totals = defaultdict(Counter)
    for text, lang in rows:
        totals[lang].update(plain_features(text))
    asked = [
        "the night", "die Nacht", "la nuit", "zzz", "wind", "", None, "12 ...", "Die NACHT über", "vent wind", "ÜBER über " * 3000,
        TEXTS["en"], TEXTS["de"], TEXTS["fr"] + " the",
    ]
    got = [r.detected for r in language.detect_language(documents(spark, [(t, None) for t in asked]), model).orderBy("doc_id").collect()]
    for text, found in zip(asked, got):
        scores = sorted(
            (sum(round(1e6 * math.log((totals[lang][b] + 1) / (sum(totals[lang].values()) + language.BUCKETS))) for b in plain_features(text)), lang)
            for lang in totals
        )
        lead = scores[-1][0] - scores[-2][0]
        assert found == (scores[-1][1] if lead >= math.ceil(math.log(20) * 1e6) else None), text
    assert got[5:8] == [None] * 3 and got[10:] == ["de", "en", "de", "fr"]


def test_profiles_add_up_and_bounds_hold(spark):
    df, _ = training(spark)
    counts = language.language_counts(df)
    halves = [language.language_counts(df.filter(F.col("doc_id") % 2 == i)) for i in (0, 1)]
    both = language.LanguageModel.from_counts(halves[0].unionByName(halves[1]))
    assert both == language.LanguageModel.from_counts(counts)
    many = spark.range(300).select(F.col("id").cast("string").alias("lang"), F.lit(0).alias("bucket"), F.lit(1).alias("n"))
    with pytest.raises(ValueError):
        language.LanguageModel.from_counts(many)
    nothing = language.LanguageModel.from_counts(counts.limit(0))
    assert language.detect_language(df, nothing).filter("detected IS NOT NULL").count() == 0
    one = language.LanguageModel.from_counts(counts.filter("lang = 'de'"))
    assert [r.detected for r in language.detect_language(documents(spark, [("x", None), ("", None)]), one).orderBy("doc_id").collect()] == ["de", None]


def test_held_out_accuracy_by_language(spark):
    detected = all_queries()["lang_detect"](spark, SMALL)
    found = {r.lang: r for r in language.language_accuracy(detected.filter("held_out")).collect()}
    assert set(found) == {"de", "en", "es", "fr"}
    assert sum(r.n_right for r in found.values()) >= 0.9 * sum(r.n for r in found.values())


# --- naive Bayes -----------------------------------------------------------------------

def plain_bayes(train, min_docs):
    counts, docs, seen = defaultdict(Counter), Counter(), defaultdict(set)
    for key, text, label in train:
        if label is None or text is None:
            continue
        docs[label] += 1
        for w in WORD.findall(text.lower()):
            counts[label][w] += 1
            seen[w].add(key)
    known = {w for w in seen if len(seen[w]) >= min_docs}
    total = {c: sum(n for w, n in counts[c].items() if w in known) for c in docs}

    def judge(text):
        scores = {}
        for c in docs:
            s = round(1e6 * math.log(docs[c] / sum(docs.values())))
            for w in WORD.findall((text or "").lower()):
                if w in known:
                    s += round(1e6 * math.log((counts[c][w] + 1) / (total[c] + len(known))))
            scores[c] = s
        best = min(scores, key=lambda c: (-scores[c], c))
        return best, 1 / sum(math.exp((s - scores[best]) / 1e6) for s in scores.values())

    return judge


TRAINING = [
    (1, "cart price vendor buy buy", "market"), (2, "price of the cart", "market"), (3, "thread reply user", "forum"),
    (4, "reply to the thread; the USER", "forum"), (5, "library of books", "library"), (6, "books and the archive", "library"),
    (7, None, "forum"), (8, "buy books", None), (9, "", "forum"), (10, "Überweisung cart", "market"), (11, "überweisung", "market"),
]


@pytest.mark.parametrize("min_docs", [1, 2])
def test_bayes_equals_the_closed_form(spark, tmp_path, min_docs):
    schema = "doc_id bigint, text string, label string"
    model = bayes.fit_bayes(spark.createDataFrame(TRAINING, schema).repartition(3), min_docs=min_docs)
    model.save(str(tmp_path / "model"))
    model = bayes.BayesModel.load(spark, str(tmp_path / "model"))
    asked = ["buy a cart", "the reply", "books", "nothing known here", "", None, "the " * 20_000 + "books", "ÜBERWEISUNG", "cart thread books"]
    rows = [(i, t, None) for i, t in enumerate(asked)]
    got = {r.doc_id: r for r in bayes.bayes_classify(model, spark.createDataFrame(rows, schema)).collect()}
    judge = plain_bayes(TRAINING, min_docs)
    assert len(got) == len(asked)
    for i, text in enumerate(asked):
        category, confidence = judge(text)
        assert got[i].category == category and got[i].confidence == pytest.approx(confidence, abs=1e-9)
        assert got[i].margin >= 0


def test_rows_that_share_a_key_are_one_document(spark):
    schema = "doc_id bigint, text string, label string"
    whole = [(1, "cart cart vendor", "market"), (2, "cart book", "library"), (None, "book shelf shelf", "library"), (3, "vendor shelf", "market")]
    cut = [(i, word, label) for i, text, label in whole for word in text.split()]
    of = lambda rows: bayes.fit_bayes(spark.createDataFrame(rows, schema))
    weights = [(m.priors, {r.token: r.weights for r in m.tokens.collect()}) for m in map(of, (whole, cut))]
    assert weights[0] == weights[1] and set(weights[0][1]) == {"cart", "vendor", "book", "shelf"}


def test_words_are_counted_inside_the_row_without_a_shuffle(spark):
    rows = [(1, "b a b"), (2, None), (None, "A 1 \u00dcber"), (3, ""), (1, "a")]
    bags = bayes._bags(spark.createDataFrame(rows, "doc_id bigint, text string"), "text", "doc_id")
    assert sorted(map(tuple, bags.filter("doc_id = 1").collect())) == [(1, "a", 1), (1, "a", 1), (1, "b", 2)]
    assert {(r.token, r.n) for r in bags.filter("doc_id IS NULL").collect()} == {("a", 1), ("\u00fcber", 1)} and bags.count() == 5
    assert "Exchange" not in bags._jdf.queryExecution().executedPlan().toString()


def test_bayes_of_no_or_one_class(spark):
    schema = "doc_id bigint, text string, label string"
    asked = spark.createDataFrame([(1, "a b", None), (None, "a", None)], schema)
    none = bayes.fit_bayes(spark.createDataFrame([(1, "a", None)], schema))
    assert none.labels == () and bayes.bayes_classify(none, asked).collect() == []
    one = bayes.fit_bayes(spark.createDataFrame([(1, "a", "only"), (2, "a", "only")], schema))
    assert [(r.category, r.confidence, r.margin) for r in bayes.bayes_classify(one, asked).collect()] == [("only", 1.0, None)] * 2


def test_bayes_finds_held_out_labels(spark):
    judged = all_queries()["ml_supervised"](spark, "/root/testdata/sf0.01").filter("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    right = F.col("category") == F.when(F.col("toxic") == 1, "market").otherwise("library")
    row = judged.join(labels, "doc_id").agg(F.count("*").alias("n"), F.count_if(right).alias("right")).first()
    assert row.right >= 0.85 * row.n


# --- calibration -----------------------------------------------------------------------

def plain_isotonic(counts, bins):
    filled = [c for c in sorted(counts) if c[1]]

    def share(a, z):
        run = [c for c in filled if a <= c[0] <= z]
        return Fraction(sum(c[2] for c in run), sum(c[1] for c in run))

    places = [c[0] for c in filled]
    fit = {p: max(min(share(a, z) for z in places if z >= p) for a in places if a <= p) for p in places}
    return [float(fit[max([q for q in places if q <= p], default=places[0])]) for p in range(bins)]


def test_isotonic_equals_greatest_of_least_means():
    rng = random.Random(1)
    for _ in range(60):
        counts = [(b, n, rng.randint(0, n)) for b in range(12) if (n := rng.choice([0, 1, 3, 10, 40]))]
        if counts:
            got = calibrate.isotonic(counts, 12)
            assert got == pytest.approx(plain_isotonic(counts, 12)) and got == sorted(got)
    assert calibrate.isotonic([], 3) == [None] * 3
    assert calibrate.isotonic([(1, 4, 1)], 3) == [0.25] * 3


def test_calibrated_confidences_and_their_error(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):  # a classifier that says c is right in c^2 of the cases
        c = rng.random()
        rows.append((i, c, rng.random() < c * c))
    judged = spark.createDataFrame([*rows, (4000, None, True), (4001, 0.5, None)], "id int, confidence double, hit boolean")
    fold = F.col("id") % 2 == 0
    before = calibrate.calibration_error(calibrate.reliability(judged.filter(~fold), F.col("hit"))).first()
    table = calibrate.fit_calibration(judged.filter(fold), F.col("hit"))
    after = judged.filter(~fold).withColumn("confidence", calibrate.calibrated(F.col("confidence"), table))
    error = calibrate.calibration_error(calibrate.reliability(after, F.col("hit"))).first()
    assert before.error > 0.1 and error.error < 0.05 and error.n == before.n == 2000
    assert after.filter("id = 4001").first().confidence == table[10]
    edge = spark.createDataFrame([(0.0,), (1.0,), (None,), (0.05,)], "c double")
    assert [r[0] for r in edge.select(calibrate.bin_of(F.col("c"))).collect()] == [0, 19, None, 1]
    assert calibrate.calibration_error(calibrate.reliability(judged.limit(0), F.col("hit"))).first().error is None


def test_calibration_error_of_the_registered_models(spark):
    rows = {r.classifier: r for r in all_queries()["calibration_error"](spark, "/root/testdata/sf0.1").collect()}
    assert rows.keys() == {"rule_based", "ml_supervised", "hybrid"} and all(r.error < 0.05 and r.n > 1000 for r in rows.values())
