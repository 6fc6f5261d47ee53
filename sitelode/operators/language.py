"""Language of a text by n-gram profiles learnt from labelled documents."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from sitelode.functions.scalars import as_col, words

LETTERS = r"\p{L}+"
#: Letters taken from the start and the end of every word.
EDGE = 3
BUCKETS = 4096
#: More languages than this are an error in the labels, not languages.
MOST_LANGUAGES = 250
#: Weights are millionths of a natural logarithm, so sums are exact in any order.
UNIT = 1_000_000
#: A verdict needs to be this many times as likely as the next language.
ODDS = 20.0


def features(text: Column | str) -> Column:
    """Bucket numbers of the start and the end of every word: character n-grams anchored at the word's edges.

    Words are runs of letters in lower case; a short word is its own start and end. The two kinds never share
    a name before hashing (`^the`, `the$`). Null and wordless texts have none.
    """
    found = words(as_col(text), LETTERS)

    def bucket(name: Column) -> Column:
        return (F.crc32(name.cast("binary")) % BUCKETS).cast("int")

    starts = F.transform(found, lambda w: bucket(F.concat(F.lit("^"), F.substring(w, 1, EDGE))))
    ends = F.transform(found, lambda w: bucket(F.concat(F.substring(w, -EDGE, EDGE), F.lit("$"))))
    return F.concat(starts, ends)


def language_counts(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n): how often each feature occurs per language, over all rows that name one.

    The profile to keep: at most languages x BUCKETS rows, summed up before the shuffle, and two profiles add up by
    bucket. A null text counts nothing.
    """
    known = documents.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(features(text)).alias("bucket"))
    return known.groupBy("lang", "bucket").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class LanguageModel:
    """Per language, by code, the weight of every bucket."""

    weights: dict[str, list[int]]

    @classmethod
    def from_counts(cls, counts: DataFrame) -> LanguageModel:
        """From a profile as `language_counts` gives it, fresh or read back; its bounded rows come to the driver."""
        languages = counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
        if languages > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages in the profile")
        return cls.from_rows(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect())

    @classmethod
    def from_rows(cls, rows: Iterable[Row]) -> LanguageModel:
        """Multinomial Bayes with one added occurrence per bucket."""
        counts: dict[str, list[int]] = {}
        for row in rows:
            counts.setdefault(row.lang, [0] * BUCKETS)[row.bucket] += row.n
        weights = {}
        for lang in sorted(counts):
            total = sum(counts[lang]) + BUCKETS
            by_count = {n: round(UNIT * math.log((n + 1) / total)) for n in set(counts[lang])}
            weights[lang] = [by_count[n] for n in counts[lang]]
        return cls(weights)


def detect_language(
    documents: DataFrame, model: LanguageModel, text: str = "text", odds: float = ODDS, out: str = "detected"
) -> DataFrame:
    """Add `out`: the likeliest language, null unless it is `odds` times as likely as the next one.

    All languages are held equally likely beforehand, so a text without words, and a short one whose words fit several
    languages, gets null by its margin, whatever its length. Exactly equal languages leave null. The profile is a constant
    of the expression, BUCKETS numbers a language: a text is judged where it is read, without join or shuffle.
    """
    if not model.weights:
        return documents.withColumn(out, F.lit(None).cast("string"))

    def scored(lang: str, table: list[int]) -> Column:
        listed = F.from_json(F.lit(json.dumps(table)), "array<bigint>")
        score = F.aggregate("_buckets", F.lit(0).cast("bigint"), lambda acc, b: acc + F.get(listed, b))
        return F.struct(score.alias("score"), F.lit(lang).alias("lang"))

    scores = [scored(lang, table) for lang, table in model.weights.items()]
    least = math.ceil(math.log(odds) * UNIT)
    ranked = documents.withColumn("_buckets", features(text)).withColumn("_ranked", F.sort_array(F.array(*scores), asc=False))
    best, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    clear = (F.size("_buckets") > 0) if len(scores) == 1 else best["score"] - second["score"] >= least
    return ranked.withColumn(out, F.when(clear, best["lang"])).drop("_buckets", "_ranked")


def language_accuracy(detected: DataFrame, lang: str = "lang", out: str = "detected") -> DataFrame:
    """(lang, n, n_right, n_open): rows per true language, how many were found, how many left open."""
    right, open_ = F.col(lang) == F.col(out), F.col(out).isNull()
    return detected.filter(F.col(lang).isNotNull()).groupBy(lang).agg(
        F.count("*").alias("n"), F.count_if(right).alias("n_right"), F.count_if(open_).alias("n_open")
    )
