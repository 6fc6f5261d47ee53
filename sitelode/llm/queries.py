"""The registered queries of this subpackage: every operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelode.llm import (
    decontaminate, ego_join, licenses, mixing, ngram_join, packing, prefix_trie, repeats, secrets, sharding, toxicity, wavelet, whitening,
)
from sitelode.llm.common import table
from sitelode.session import materialize, scratch_path

SHARDS = 24


def op1_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"] != secrets.ENTROPY_KIND)

    def number(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return spans.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
        number("entropy"),
    )


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.with_text_size(table(spark, sf_dir, "documents").select("doc_id", "text"))
    dealt = sharding.shard(docs, "doc_id", SHARDS, carry=["size", "text_crc32"], order=["text_crc32", "size"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_texts(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a source is a repository; every hundredth id is the license file of its directory, every thousandth that of the language folder."""
    number, named = F.col("doc_id"), F.col("doc_id").cast("string")
    folder = F.concat_ws("/", "source", "lang")
    path = (
        F.when(number % 1000 == 0, F.concat(folder, F.lit("/LICENSE-"), named))
        .when(number % 100 == 0, F.concat(folder, F.lit("/"), (number / 100).cast("bigint").cast("string"), F.lit("/LICENSE")))
        .otherwise(F.concat(folder, F.lit("/"), F.floor(number / 100).cast("string"), F.lit("/"), named))
    )
    return licenses.scan_licenses(table(spark, sf_dir, "documents").withColumn("path", path), keep=("doc_id",))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    wavelet.write_tokens(table(spark, sf_dir, "documents"), path)
    return wavelet.read_documents(spark, path)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Trained on labelled documents outside the held-out third."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~_held_out())
    return toxicity.fit_sample(labels, table(spark, sf_dir, "documents"))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, sf_dir)
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), model)
    return scored.select(
        "doc_id", _held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.col("toxic").alias("flagged_by_language"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return prefix_trie.prefix_trie(prefix_trie.respliced(lists, head, every=5, most=8))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # texts are measured once; only numbers go on
    sized = materialize(
        docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.draw(F.col("doc_id"), F.col("text")).alias("draw")), "sizes"
    )
    targets = materialize(mixing.source_targets(sized), "targets")
    counted = mixing.with_copies(sized, targets)
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_embedding_near_dup, op2_secret_scan, op3_repeats, op4_sharding, op5_ngram_join, op6_license_scan, op7_best_fit_packing, op8_decontamination, op9_toxicity, op10_token_wavelet, op11_conversation_trie, op12_embedding_whitening, op13_source_mixing)
}
