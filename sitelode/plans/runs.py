"""Runs that write findings back: safety, content hashes, risk, changes, metrics snapshot, audit log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from sitelode.functions.layout import spread_small
from sitelode.functions.scalars import content_hash, risk_bucket, risk_score, title_hash, ts, typed_id
from sitelode.operators.catalog import honeypot_flag, with_site_values
from sitelode.operators.dedup import BITS, hash_upsert, text_simhash
from sitelode.operators.metrics import change_detect, latest_classification, latest_safety, request_aggregates
from sitelode.operators.quality import fill_defaults
from sitelode.operators.safety import MAX_CONTENT_BYTES, pattern_flag, safety_check, size_gate
from sitelode.schema import SAFETY_ACTION
from sitelode.session import materialize
from sitelode.sources.text_lists import Pattern

FILTER_VERSION = "patterns-1"
#: Actions from the mildest to the one that decides.
SEVERITY = ("allow", "review", "quarantine", "block")


@dataclass(frozen=True)
class Checked:
    safety_checks: DataFrame
    sites: DataFrame


def safety_run(
    sites: DataFrame,
    contents: DataFrame,
    patterns: Sequence[Pattern],
    as_of: datetime | str,
    *,
    filter_version: str = FILTER_VERSION,
    max_bytes: int = MAX_CONTENT_BYTES,
    known_honeypots: DataFrame | None = None,
    key_type: str = "string",
) -> Checked:
    """Check contents (site_id, text[, risk_factors]) of known sites and write the verdicts back.

    Every distinct content of a site gives one `safety_checks` row with the hash of what was checked and the version of the
    filter; its id comes from these, so a run that is repeated makes the same rows. A site takes its gravest action: blocked
    ones are marked illegal, reviewed and quarantined ones for review, flags that are set stay. A site is a honeypot by its own
    flag or by the list of addresses, and is marked as one. A null text is checked as empty; contents of unknown sites are left out. Texts
    are read once and not shuffled: the verdicts alone meet the sites.
    """
    factors = F.col("risk_factors") if "risk_factors" in contents.columns else F.lit(None).cast("array<string>")
    text = F.coalesce("text", F.lit(""))
    read = spread_small(contents.select("site_id", text.alias("text"), factors.alias("risk_factors")), "site_id")
    scanned = size_gate(pattern_flag(read, patterns), max_bytes=max_bytes)
    found = materialize(
        scanned.select("site_id", content_hash("text").alias("checked_content_hash"), "flagged_categories", "over_size", "risk_factors"), "scanned"
    )
    listed = honeypot_flag(sites, known_honeypots) if known_honeypots is not None else sites.withColumn("known_honeypot", F.lit(False))
    trap = F.coalesce("is_honeypot", F.lit(False)) | F.col("known_honeypot")
    judged = safety_check(found.join(listed.select("site_id", trap.alias("is_honeypot")), "site_id"))
    rows = judged.select(
        typed_id(key_type, "site_id", "checked_content_hash", F.lit(filter_version), ts(as_of)).alias("id"), "site_id", "is_safe", "action_taken",
        "flagged_categories", "risk_factors", F.lit(filter_version).alias("filter_version"), "checked_content_hash",
    ).dropDuplicates(["id"])
    checks = materialize(fill_defaults(rows, "safety_checks", as_of, add_missing=True), "safety-checks")

    grade = F.array_position(F.array(*[F.lit(a) for a in SEVERITY]), F.col("action_taken"))
    worst = checks.groupBy("site_id").agg(F.max(grade).alias("grade"))
    flags = worst.select(
        "site_id",
        F.when(F.col("grade") == SEVERITY.index("block") + 1, True).alias("is_illegal"),
        F.when(F.col("grade").between(2, 3), True).alias("requires_review"),
    )
    traps = listed.filter("known_honeypot").select("site_id", F.lit(True).alias("is_honeypot"))
    return Checked(checks, with_site_values(with_site_values(sites, flags), traps))


def content_hash_rows(contents: DataFrame, as_of: datetime | str, *, mime_type: str = "text/html", key_type: str = "string") -> DataFrame:
    """`content_hashes` rows of type title, document and text_simhash from (site_id, title, text[, fetched_at]).

    Title and document carry SHA-256, the similarity hash its 60 bits as 15 hex digits. A site has one row of each type, that of
    its newest content (`fetched_at`, by default `as_of`; of equally new ones the greatest hash). Null titles and texts, and texts without
    a word for the similarity hash, give none. `content_size` is in bytes of what was hashed, null beyond 32 bits.
    """
    at = F.col("fetched_at") if "fetched_at" in contents.columns else ts(as_of)
    numbered = materialize(contents.select("site_id", "title", "text", at.alias("created_at")).withColumn("_no", F.monotonically_increasing_id()), "contents")

    def made(kind: str, value: Column, source: str, algorithm: str) -> Column:
        size = F.octet_length(source).cast("bigint")
        return F.struct(
            F.lit(kind).alias("hash_type"), value.alias("hash_value"), F.lit(algorithm).alias("algorithm"),
            F.when(size <= 2**31 - 1, size.cast("int")).alias("content_size"),
        )

    alike = text_simhash(numbered.filter(F.col("text").isNotNull()), "_no", "text").withColumnRenamed("_no", "_of")
    joined = numbered.join(alike, F.col("_no") == F.col("_of"), "left")
    kinds = F.array(
        made("title", title_hash("title"), "title", "sha256"),
        made("document", content_hash("text"), "text", "sha256"),
        made("text_simhash", F.lower(F.lpad(F.hex("simhash"), BITS // 4, "0")), "text", "simhash60-md5"),
    )
    rows = joined.select("site_id", "created_at", F.explode(kinds).alias("h")).select("site_id", "created_at", "h.*").filter("hash_value IS NOT NULL")
    keep = ("hash_value", "algorithm", "content_size", "created_at")
    newest = rows.groupBy("site_id", "hash_type").agg(F.max_by(F.struct(*keep), F.struct("created_at", "hash_value")).alias("row"))
    typed = newest.select(
        typed_id(key_type, "site_id", "hash_type", "row.hash_value", "row.created_at").alias("id"), "site_id", "hash_type", "row.*",
        F.when(F.col("hash_type") != "title", mime_type).alias("mime_type"),
    )
    return fill_defaults(typed, "content_hashes", as_of, add_missing=True)


def hash_run(content_hashes: DataFrame, contents: DataFrame, as_of: datetime | str, **options: str) -> DataFrame:
    """The hash table after new contents: one row per site and type, the newest wins."""
    return hash_upsert(content_hashes, content_hash_rows(contents, as_of, **options))


def risk_run(sites: DataFrame, classifications: DataFrame, safety_checks: DataFrame) -> DataFrame:
    """The sites with `risk_score` (six digits) and `risk_level` from their newest classification and safety check.

    Sites with neither keep the score they have.
    """
    newest = latest_classification(classifications).select("site_id", "confidence")
    checked = latest_safety(safety_checks)
    flagged = F.when(F.col("is_illegal"), F.array(F.lit("flagged")))
    if "flagged_categories" in checked.columns:
        flagged = F.when(F.size("flagged_categories") > 0, F.col("flagged_categories")).otherwise(flagged)
    found = newest.join(checked.select("site_id", flagged.alias("flagged"), "risk_factors", F.lit(True).alias("checked")), "site_id", "full_outer")
    scored = sites.select("site_id", "is_honeypot").join(found, "site_id")
    score = F.round(risk_score(F.col("flagged"), F.col("risk_factors"), F.col("is_honeypot"), F.col("confidence")), 6)
    values = scored.select("site_id", score.alias("risk_score")).withColumn("risk_level", risk_bucket("risk_score"))
    return with_site_values(sites, values)


def change_run(sites: DataFrame, discovery_results: DataFrame) -> DataFrame:
    """The sites with `last_changed` from their observed content; an earlier or missing finding leaves the value."""
    found = change_detect(discovery_results).select("site_id", "last_changed")
    if "last_changed" in sites.columns:
        known = sites.select("site_id", F.col("last_changed").alias("_known"))
        found = found.join(known, "site_id", "left").select("site_id", F.greatest("last_changed", "_known").alias("last_changed"))
    return with_site_values(sites, found)


def metrics_snapshot(
    sites: DataFrame,
    safety_checks: DataFrame,
    request_log: DataFrame,
    resource_states: DataFrame,
    as_of: datetime | str,
    *,
    minutes: int = 60,
    key_type: str = "string",
) -> DataFrame:
    """One `system_metrics` row: the catalog's counts, the resources in use, and the requests of the `minutes` before `as_of`.

    The window includes its start and not `as_of`. Samples of the host (memory, processor, disk, traffic) are null: they come
    from its own agent. Four small aggregates, stacked and folded to one row.
    """
    now = ts(as_of)
    recent = request_log.filter((F.col("ts") >= now - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("ts") < now))
    parts = [
        sites.agg(F.count("*").alias("sites_discovered"), F.count("category").alias("sites_classified")),
        safety_checks.agg(F.count("*").alias("safety_checks_performed")),
        resource_states.agg(F.count("*").alias("circuits_total"), F.count_if(F.col("state") != "dead").alias("circuits_active")),
        recent.agg(*request_aggregates(minutes)),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    row = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    return fill_defaults(row.withColumn("id", typed_id(key_type, F.lit("system_metrics"), now)), "system_metrics", as_of, add_missing=True)


def audit_rows(entries: DataFrame, as_of: datetime | str, key_type: str = "string") -> DataFrame:
    """`audit_logs` rows to append, from (component, action, status[, researcher_id, user_agent, ip_address, details, error_message, created_at]).

    An entry without `id` takes one from all its columns, so a repeated batch makes the same rows; entries alike
    in all columns are one. `created_at` is `as_of` where it is not given.
    """
    rows = entries
    if "id" not in rows.columns:
        rows = rows.withColumn("id", typed_id(key_type, *rows.columns, ts(as_of))).dropDuplicates(["id"])
    return fill_defaults(rows, "audit_logs", as_of, add_missing=True, key_type=key_type)


assert set(SEVERITY) == set(SAFETY_ACTION)
