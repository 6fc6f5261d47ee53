"""Discovery and classification runs: compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from sitelode.functions.scalars import ts, typed_id
from sitelode.operators.bayes import BayesModel, bayes_classify
from sitelode.operators.catalog import fresh_id, new_addresses, site_upsert, unclassified_sites, with_site_values
from sitelode.operators.classify import CONFIDENCE_THRESHOLD, DEFAULT_RULES, Rule, confidence_gate, rule_classify
from sitelode.operators.content import PAGES_PER_SITE, host_of, link_bfs, page_cap
from sitelode.operators.jobs import create_crawl_jobs
from sitelode.operators.quality import address_error, fill_defaults
from sitelode.schema import MODEL_TYPE
from sitelode.session import materialize
from sitelode.sources.text_lists import seed_parse

RULE_MODEL_VERSION = "rules-1"


@dataclass(frozen=True)
class Discovery:
    """Rows a discovery run adds or changes."""

    sites: DataFrame
    discovery_results: DataFrame
    crawl_jobs: DataFrame
    rejected: DataFrame


@dataclass(frozen=True)
class Classified:
    classifications: DataFrame
    sites: DataFrame


def append_discoveries(found: DataFrame, as_of: datetime | str, key_type: str = "string") -> DataFrame:
    """Discovery rows from (site_id, discovery_method[, source_url, confidence, raw_content_hash]).

    Give an `id` or it is derived from the other columns, in the key type of the table; `site_id` keeps its type.
    """
    rows = found
    if "id" not in rows.columns:
        source = F.col("source_url") if "source_url" in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn("id", typed_id(key_type, "site_id", "discovery_method", source, ts(as_of)))
    if "processing_time" in rows.columns:
        rows = rows.drop("processing_time")
    return fill_defaults(rows, "discovery_results", as_of, add_missing=True)


def discovery_run(
    seed_lines: DataFrame,
    links: DataFrame,
    sites: DataFrame,
    as_of: datetime | str,
    max_depth: int = 2,
    max_pages: int = PAGES_PER_SITE,
    key_type: str = "string",
) -> Discovery:
    """Follow stored links from the seeds and register the addresses not yet known.

    `links` has (src_address, url). Seeds are found at depth 0 by method `seed`,
    the rest by `crawl`. Each new address is inserted once, with one discovery
    row, and gets a job for every linked page up to `max_pages`, its root page first. The three
    carry the site's id in the type of `sites.site_id`; `key_type` is that of the new rows' own ids.
    """
    # read for the first round and for what is rejected; a list is often one small file, so its lines are dealt to all tasks
    seeds = materialize(seed_parse(seed_lines.select("value").repartition("value")).drop("line"), "seeds")
    # read once per round and once for the pages, and often parsed out of stored HTML
    targets = materialize(
        links.select(F.col("src_address").alias("src"), host_of("url").alias("dst"), "url").na.drop(), "links"
    )
    reach = link_bfs(
        targets.select("src", "dst"), seeds.filter("is_valid").select(F.col("address").alias("node")), max_depth
    ).withColumnRenamed("node", "address")
    rejected = seeds.filter(~F.col("is_valid")).select("address", "error").unionByName(
        reach.select("address", address_error("address").alias("error")).filter("error IS NOT NULL")
    ).distinct()

    valid = reach.filter(address_error("address").isNull())
    fresh = materialize(valid.join(new_addresses(valid, sites), "address", "left_semi"), "fresh")
    site_id = fresh_id(F.col("address"), dict(sites.dtypes)["site_id"])
    inserted = site_upsert(sites, fresh.select("address", F.lit(0).alias("seq")), as_of)

    method = F.when(F.col("depth") == 0, "seed").otherwise("crawl")
    results = append_discoveries(
        fresh.select(site_id.alias("site_id"), method.alias("discovery_method"), F.lit(1.0).alias("confidence")), as_of, key_type
    )

    # a popular address brings each of its links once, whatever the number of pages that hold it
    linked = targets.select(F.col("dst").alias("address"), "url").distinct().join(fresh.select("address", "depth"), "address")
    root = F.concat(F.lit("http://"), "address", F.lit("/"))
    pages = fresh.select("address", "depth", root.alias("url")).unionByName(linked.select("address", "depth", "url")).distinct()
    capped = page_cap(pages.withColumn("inner", F.col("url") != root), "address", ("depth", "inner", "url"), max_pages)
    jobs = create_crawl_jobs(
        capped.select(
            site_id.alias("site_id"), "url", (-F.col("depth")).alias("priority"), F.lit(max_depth).alias("max_depth")
        ),
        as_of,
        key_type,
    )
    return Discovery(inserted, results, jobs, rejected)


def by_rules(rules: Sequence[Rule] = DEFAULT_RULES) -> Callable[[DataFrame], DataFrame]:
    """The keyword rules as a classifier for `classify_run`."""
    return lambda contents: rule_classify(contents, rules)


def by_bayes(model: BayesModel) -> Callable[[DataFrame], DataFrame]:
    """A fitted Bayes model as a classifier for `classify_run`; texts of one site are judged one by one."""
    def judge(contents: DataFrame) -> DataFrame:
        numbered = materialize(contents.withColumn("_text_no", F.monotonically_increasing_id()), "contents")
        judged = bayes_classify(model, numbered, "_text_no")
        return numbered.select("site_id", "_text_no").join(judged, "_text_no").select("site_id", "category", "confidence")

    return judge


def classify_run(
    sites: DataFrame,
    contents: DataFrame,
    as_of: datetime | str,
    rules: Sequence[Rule] = DEFAULT_RULES,
    threshold: float = CONFIDENCE_THRESHOLD,
    site_id: object | None = None,
    *,
    classifier: Callable[[DataFrame], DataFrame] | None = None,
    model_type: str = "rule_based",
    model_version: str = RULE_MODEL_VERSION,
    key_type: str = "string",
) -> Classified:
    """Classify unclassified sites (or one site) by their content, any number of (site_id, text) rows per site.

    `classifier` gives (site_id, category, confidence) for such rows, the keyword rules unless another is given; its kind and
    version are kept in the classification rows. The verdict of a site is that of its text with the highest confidence, of equal
    ones the first category. Every classified site gets a classification row. The site takes the category
    when the confidence passes the gate, and is marked for review otherwise.
    """
    if model_type not in MODEL_TYPE:
        raise ValueError(f"model_type must be one of {MODEL_TYPE}")
    chosen = sites.filter(F.col("site_id") == F.lit(site_id)) if site_id is not None else unclassified_sites(sites)
    wanted = contents.join(chosen.select("site_id"), "site_id", "left_semi")
    judged = confidence_gate((classifier or by_rules(rules))(wanted), threshold)
    # both results below come from the verdicts, so the texts are read once
    verdicts = ("category", "confidence", "accepted", "requires_review")
    best = judged.groupBy("site_id").agg(F.min_by(F.struct(*verdicts), F.struct(-F.col("confidence"), "category")).alias("v"))
    judged = materialize(best.select("site_id", *[F.col(f"v.{c}").alias(c) for c in verdicts]), "verdicts")
    rows = judged.select(
        typed_id(key_type, "site_id", F.lit(model_version), ts(as_of)).alias("id"),
        "site_id",
        "category",
        "confidence",
        F.lit(model_version).alias("model_version"),
        F.lit(model_type).alias("model_type"),
    )
    classifications = fill_defaults(rows, "classifications", as_of, add_missing=True)
    accepted = judged.select("site_id", F.when(F.col("accepted"), F.col("category")).alias("category"), "requires_review")
    return Classified(classifications, with_site_values(sites, accepted))
