"""Site classification: keyword rules, trained and unsupervised models, and the gate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from sitelode.functions.scalars import one_of, words

CONFIDENCE_THRESHOLD = 0.7
FALLBACK = "other"


@dataclass(frozen=True)
class Rule:
    category: str
    keyword: str
    weight: float = 1.0


# --- fixed values: default keyword rules --------------------------------------------
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("blog", "blog"), Rule("blog", "article"), Rule("blog", "diary"), Rule("blog", "posted"),
    Rule("forum", "forum"), Rule("forum", "thread"), Rule("forum", "reply"), Rule("forum", "moderator"),
    Rule("hidden_service", "mirror", 0.5), Rule("hidden_service", "gateway"), Rule("hidden_service", "relay"),
    Rule("library", "library"), Rule("library", "archive"), Rule("library", "ebook"), Rule("library", "catalogue"),
    Rule("market", "market"), Rule("market", "vendor"), Rule("market", "cart"), Rule("market", "escrow"),
    Rule("mirror", "mirror"), Rule("mirror", "clone"),
    Rule("service", "email"), Rule("service", "hosting"), Rule("service", "wallet"), Rule("service", "messenger"),
)


def rule_classify(documents: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text: str = "text") -> DataFrame:
    """Add `category` and `confidence` from keyword rules.

    A category scores the weights of its keywords that occur at least once;
    confidence is the best score over the sum of all. Equal scores go to the lower
    category name; without any hit it is `other` with 0. The rules are constants
    of the expression, so a document is classified where it is read.
    """
    keywords = sorted({r.keyword for r in rules})
    hits = F.array_distinct(F.filter(words(text), lambda w: one_of(w, keywords)))
    scores = []
    for rank, category in enumerate(sorted({r.category for r in rules})):
        score = F.lit(0.0)
        for rule in rules:
            if rule.category == category:
                hit = F.array_contains("_hits", rule.keyword)
                score = score + F.when(hit, F.lit(float(rule.weight))).otherwise(0.0)
        scores.append(F.struct(score.alias("score"), F.lit(-rank).alias("order"), F.lit(category).alias("category")))
    scored = documents.withColumn("_hits", hits).withColumn("_scores", F.array(*scores))
    best = F.array_max("_scores")
    total = F.aggregate("_scores", F.lit(0.0), lambda acc, s: acc + s["score"])
    return (
        scored.withColumns({"_best": best, "_total": total})
        .withColumns(
            {
                "category": F.when(F.col("_total") > 0, F.col("_best.category")).otherwise(FALLBACK),
                "confidence": F.when(F.col("_total") > 0, F.col("_best.score") / F.col("_total")).otherwise(0.0),
            }
        )
        .drop("_hits", "_scores", "_best", "_total")
    )


def confidence_gate(classified: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Add `accepted` (confidence at or above the threshold) and `requires_review`."""
    accepted = F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    return classified.withColumn("accepted", accepted).withColumn("requires_review", ~F.col("accepted"))


def train_supervised(
    training: DataFrame, text: str = "text", label: str = "label", n_features: int = 1 << 16, max_iter: int = 20
) -> PipelineModel:
    """Fit word-count features with inverse document frequency and logistic regression.

    The iterative alternative to `bayes.fit_bayes`. Words are hashed into `n_features` places, words in fewer than two texts
    are left out, and the regression stops after `max_iter` passes over the training rows. The fitted pipeline has
    Spark's own save and load.
    """
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip")
    labels = indexer.fit(training)
    stages = [
        labels,
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\P{L}+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=n_features),
        IDF(inputCol="_tf", outputCol="_features", minDocFreq=2),
        LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=max_iter, regParam=0.01),
        IndexToString(inputCol="prediction", outputCol="category", labels=labels.labels),
    ]
    return Pipeline(stages=stages).fit(training.filter(F.col(text).isNotNull()))


def ml_supervised(model: PipelineModel, documents: DataFrame, key: str = "doc_id", label: str = "label") -> DataFrame:
    """(key, category, confidence): predicted category and its probability."""
    features = PipelineModel([s for s in model.stages if s.uid != model.stages[0].uid])
    scored = features.transform(documents)
    return scored.select(key, "category", F.array_max(vector_to_array("probability")).alias("confidence"))


def ml_unsupervised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, seed: int = 7) -> DataFrame:
    """(key, cluster): k-means clusters of the vectors, repeatable by the seed."""
    ready = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_features"))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(ready)
    return model.transform(ready).select(key, "cluster")


def hybrid_classify(
    by_rule: DataFrame, by_model: DataFrame, key: str = "doc_id", threshold: float = CONFIDENCE_THRESHOLD
) -> DataFrame:
    """The rule result where it is confident enough, else the model's where there is one.

    The threshold is one for both, so give confidences of one scale: see `calibrate`. A rule result without a
    confidence gives way to the model.
    """
    model = by_model.select(key, F.col("category").alias("_category"), F.col("confidence").alias("_confidence"))
    joined = by_rule.join(model, key, "left")
    keep = F.coalesce(F.col("confidence") >= threshold, F.lit(False)) | F.col("_category").isNull()
    return joined.select(
        key,
        F.when(keep, F.col("category")).otherwise(F.col("_category")).alias("category"),
        F.when(keep, F.col("confidence")).otherwise(F.col("_confidence")).alias("confidence"),
        F.when(keep, "rule_based").otherwise("ml_supervised").alias("decided_by"),
    )
