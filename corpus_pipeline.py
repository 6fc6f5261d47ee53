"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and reread as the next one's `docs`. All but the last return the columns of
`documents`; rows with null or repeated ids are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelode.llm import decontaminate, ngram_join, packing, queries, secrets, toxicity
from sitelode.llm.common import table
from sitelode.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold of their language."""
    model = queries.toxicity_model(spark, sf_dir)
    return toxicity.score(docs.select(*COLUMNS), model).filter(~F.col("toxic")).select(*COLUMNS)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram Jaccard similarity: the one with the smallest id.

    Rows without an id stay; rows that repeat an id stay or go together.
    """
    linked = ngram_join.linked_texts(docs.select("doc_id", "text"))
    gone = linked.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret span replaced by a mark; n_chars follows the text."""
    found = secrets.find_secrets(docs.select(*COLUMNS), out="_spans")
    masked = found.withColumn("text", secrets.redacted(found, spans="_spans"))
    counted = F.when(F.size("_spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", counted).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document placed in training sequences: doc_id, piece, n_pieces, length, offset, pack_group, bin, place."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_group),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
