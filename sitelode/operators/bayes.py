"""Supervised text classification by a table of token weights: multinomial naive Bayes in two aggregates and a join."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sitelode.functions.scalars import words
from sitelode.session import materialize

LETTERS = r"\p{L}+"
MIN_DOCS = 2
#: More classes than this are an error in the labels.
MOST_LABELS = 1000
#: Weights are millionths of a natural logarithm, so sums are exact in any order.
UNIT = 1_000_000


@dataclass(frozen=True)
class BayesModel:
    """Classes by name with their weight beforehand, and (token, weights), weights in the order of the classes."""

    labels: tuple[str, ...]
    priors: tuple[int, ...]
    tokens: DataFrame

    def save(self, path: str) -> None:
        spark = self.tokens.sparkSession
        self.tokens.write.parquet(f"{path}/tokens")
        spark.createDataFrame(list(zip(self.labels, self.priors)), "label string, prior bigint").write.parquet(f"{path}/labels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BayesModel:
        rows = spark.read.parquet(f"{path}/labels").orderBy("label").collect()
        return cls(tuple(r.label for r in rows), tuple(r.prior for r in rows), spark.read.parquet(f"{path}/tokens"))


#: Texts whose words are counted in one go.
SLICE_ROWS = 256


def _bags(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep ..., token, n): the distinct words of every row and how often it has them, counted inside the row without a shuffle."""
    listed = rows.select(*keep, words(F.col(text), LETTERS).alias("_words"))
    out = T.StructType([*listed.schema.fields[:-1], T.StructField("token", T.StringType()), T.StructField("n", T.LongType())])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                found = part.column("_words")
                lengths = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
                coded = found.flatten().dictionary_encode()
                size = max(1, len(coded.dictionary))
                pairs = np.repeat(np.arange(part.num_rows), lengths) * size + coded.indices.to_numpy()
                pairs, times = np.unique(pairs, return_counts=True)
                kept = [part.column(name).take(pa.array(pairs // size)) for name in keep]
                tokens = coded.dictionary.take(pa.array(pairs % size)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*kept, tokens, pa.array(times, pa.int64())], names=[*keep, "token", "n"])

    return listed.mapInArrow(counted, out)


def _log_share(part: Column, whole: Column) -> Column:
    return F.round(F.lit(float(UNIT)) * F.log(part.cast("double") / whole.cast("double"))).cast("bigint")


def fit_bayes(training: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", min_docs: int = MIN_DOCS) -> BayesModel:
    """Count the words of each class and turn them into weights.

    The vocabulary is every lower-case word (run of letters) in at least `min_docs` training documents. The weight of a word in a class is the logarithm
    of (n + 1) / (N + V): n its occurrences there, N those of all vocabulary words, V the size of the vocabulary. A class counts
    beforehand by its share of documents. Rows without label or text are left out; rows that share a key are one
    document. Words are counted inside each row and summed per class before the shuffle; only rows that share a key meet by word
    and key first. So neither a frequent word nor a large class gathers in a task, and a task holds its vocabulary, not its texts. Only
    one row per class reaches the driver. The weights are written once and can be saved and loaded.
    """
    known = training.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(text).alias("text")
    )
    repeated = materialize(known.groupBy("label", "key").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "repeated-keys")
    bags = _bags(known, "text", "key", "label")
    if not repeated.isEmpty():
        same = (F.col("label") == F.col("_label")) & F.col("key").eqNullSafe(F.col("_repeated"))
        named = repeated.select(F.col("label").alias("_label"), F.col("key").alias("_repeated"))
        once = _bags(known.join(named, same, "left_anti"), "text", "key", "label")
        folded = _bags(known.join(named, same, "left_semi"), "text", "key", "label").groupBy("token", "label", "key").agg(F.sum("n").alias("n"))
        bags = once.unionByName(folded.select("key", "label", "token", "n"))
    per_label = bags.groupBy("token", "label").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    counted = materialize(
        per_label.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_docs).select("token", "counts"),
        "token-counts",
    )
    vocabulary = counted.count()
    totals = counted.select(F.explode("counts").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("total"))
    documents = known.groupBy("label").agg(F.count_distinct("key").alias("docs"))
    rows = documents.join(totals, "label", "left").orderBy("label").limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} classes")
    everything = sum(r.docs for r in rows)
    priors = tuple(round(UNIT * math.log(r.docs / everything)) for r in rows)
    weights = [
        _log_share(F.coalesce(F.try_element_at("counts", F.lit(r.label)), F.lit(0)) + 1, F.lit((r.total or 0) + vocabulary)) for r in rows
    ]
    tokens = counted.select("token", (F.array(*weights) if weights else F.array().cast("array<bigint>")).alias("weights"))
    return BayesModel(tuple(r.label for r in rows), priors, materialize(tokens, "token-weights"))


def bayes_classify(model: BayesModel, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, category, confidence, margin): the likeliest class, its probability, and the lead over the next in natural logarithms.

    Words outside the vocabulary count nothing; a text without known words is judged by the class sizes alone. Equal classes
    go to the first name. Words are counted inside each row before they meet the weights in a join on the word, which Spark
    broadcasts or splits by the written size of the vocabulary and the frequency of words. Keys should be unique: rows that
    share one are judged by their words together, rows without a key by the class sizes. With one class the margin is null.
    """
    names = [f"_s{i}" for i in range(len(model.labels))]
    if not names:
        kind = dict(documents.dtypes)[key]
        return documents.sparkSession.createDataFrame([], f"{key} {kind}, category string, confidence double, margin double")
    met = _bags(documents.withColumn("_key", F.col(key)), text, "_key").join(model.tokens, "token")
    sums = met.groupBy("_key").agg(*[F.sum(F.col("n") * F.get("weights", F.lit(i))).alias(name) for i, name in enumerate(names)])
    joined = documents.select(key).join(sums, F.col(key) == F.col("_key"), "left")
    scores = [
        F.struct((F.coalesce(F.col(name), F.lit(0)) + prior).alias("score"), F.lit(-i).alias("order"), F.lit(label).alias("label"))
        for i, (name, prior, label) in enumerate(zip(names, model.priors, model.labels))
    ]
    ranked = joined.select(key, F.sort_array(F.array(*scores), asc=False).alias("ranked"))
    best = F.get("ranked", F.lit(0))
    # summed in the order of the ranking, so the same scores always give the same number
    total = F.aggregate("ranked", F.lit(0.0), lambda acc, s: acc + F.exp((s["score"] - best["score"]).cast("double") / float(UNIT)))
    margin = (best["score"] - F.get("ranked", F.lit(1))["score"]).cast("double") / float(UNIT)
    return ranked.select(key, best["label"].alias("category"), (1.0 / total).alias("confidence"), margin.alias("margin"))
