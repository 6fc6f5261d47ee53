"""Counts, rollups and newest-row views over the catalog and its logs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from sitelode.functions.layout import exact_lag
from sitelode.functions.scalars import ts
from sitelode.schema import AUDIT_STATUS

LIFETIME_S = 600
MAX_REQUESTS = 100


def mirror_groups(sites: DataFrame) -> DataFrame:
    """Groups of sites with equal (title_hash, language), with a canonical address.

    Canonical is the site seen first (unknown times last), then the lower address.
    A group is described by aggregates only; its members are in `mirror_members`.
    """
    known = sites.na.drop(subset=["title_hash", "language"])
    first = F.min(F.struct(F.col("first_seen").isNull().alias("unseen"), "first_seen", "address"))
    return (
        known.groupBy("title_hash", "language")
        .agg(F.count("*").alias("n_sites"), first.alias("first"))
        .filter("n_sites > 1")
        .select(
            "title_hash",
            "language",
            "n_sites",
            F.col("first.address").alias("canonical_address"),
            F.col("first.first_seen").alias("first_seen"),
        )
    )


def mirror_members(sites: DataFrame) -> DataFrame:
    """(address, canonical_address) for every site in a mirror group."""
    groups = mirror_groups(sites).select("title_hash", "language", "canonical_address")
    return sites.join(groups, ["title_hash", "language"]).select("address", "canonical_address")


def catalog_counts(sites: DataFrame, safety_checks: DataFrame) -> DataFrame:
    """One row: sites discovered, sites classified, safety checks performed."""
    per_table = sites.agg(
        F.count("*").alias("sites_discovered"),
        F.count_if(F.col("category").isNotNull()).alias("sites_classified"),
        F.lit(0).cast("bigint").alias("safety_checks_performed"),
    ).unionByName(
        safety_checks.agg(
            F.lit(0).cast("bigint").alias("sites_discovered"),
            F.lit(0).cast("bigint").alias("sites_classified"),
            F.count("*").alias("safety_checks_performed"),
        )
    )
    return per_table.agg(*[F.sum(c).alias(c) for c in per_table.columns])


def status_rollup(sites: DataFrame, levels: Sequence[str] = ("status", "category", "risk_level")) -> DataFrame:
    """Site counts with subtotals; `grouping_id` tells a subtotal from a null value."""
    return sites.rollup(*levels).agg(F.grouping_id().alias("grouping_id"), F.count("*").alias("n_sites"))


def discovery_by_method(results: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct("site_id") if approximate else F.count_distinct("site_id")
    return results.groupBy("discovery_method").agg(
        F.count("*").alias("n_results"),
        distinct.alias("n_sites"),
        F.avg("confidence").alias("mean_confidence"),
    )


def request_metrics(log: DataFrame, minutes: int = 60) -> DataFrame:
    """Requests per minute, error rate and mean response time per time bucket."""
    return (
        log.groupBy(F.window("ts", f"{int(minutes)} minutes").alias("w"))
        .agg(*request_aggregates(minutes))
        .select(F.col("w.start").alias("bucket_start"), "requests_per_minute", "error_rate", "avg_response_time")
    )


def request_aggregates(minutes: int) -> list[Column]:
    return [
        (F.count("*") / F.lit(float(minutes))).alias("requests_per_minute"),
        F.avg(F.col("is_error").cast("int")).alias("error_rate"),
        F.avg("response_time").alias("avg_response_time"),
    ]


def audit_rollup(logs: DataFrame) -> DataFrame:
    """Events per component and action, one column per status."""
    per_status = [F.count_if(F.col("status") == s).alias(s) for s in AUDIT_STATUS]
    return logs.groupBy("component", "action").agg(*per_status)


def audit_filter(
    logs: DataFrame,
    component: str | None = None,
    action: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Audit rows by component and action, or by time range [since, until) and status.

    On a table written by day (column `day`) a time range reads only its days.
    """
    found = logs
    by_day = "day" in logs.columns
    for column, wanted in (("component", component), ("action", action), ("status", status)):
        if wanted:
            found = found.filter(F.col(column) == wanted)
    if since is not None:
        found = found.filter(F.col("created_at") >= ts(since))
        if by_day:
            found = found.filter(F.col("day") >= ts(since).cast("date"))
    if until is not None:
        found = found.filter(F.col("created_at") < ts(until))
        if by_day:
            found = found.filter(F.col("day") <= ts(until).cast("date"))
    return found


def tag_counts(df: DataFrame, column: str = "tags") -> DataFrame:
    return (
        df.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    )


def _newest(df: DataFrame, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Row with the greatest `order` per site, by a partial aggregate rather than a window."""
    picked = df.groupBy("site_id").agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("row"))
    return picked.select("site_id", "row.*")


def latest_classification(classifications: DataFrame) -> DataFrame:
    keep = [c for c in classifications.columns if c != "site_id"]
    return _newest(classifications, ["classified_at", "id"], keep)


def latest_safety(checks: DataFrame) -> DataFrame:
    """Newest check per site and the site flags that follow from its action."""
    keep = [c for c in checks.columns if c != "site_id"]
    return _newest(checks, ["checked_at", "id"], keep).withColumns(
        {
            "is_illegal": F.col("action_taken") == "block",
            "requires_review": F.col("action_taken").isin("review", "quarantine"),
        }
    )


def change_detect(results: DataFrame, parts: int | None = None) -> DataFrame:
    """Per site: observations, changes, and when the content changed last.

    A change is a hash that differs from the previous one of the site; the first
    observation is none. Order: moment, then id, of any sortable type. `parts` sets
    the number of ranges the rows are cut into (default: the shuffle partitions).
    """
    seen = results.filter(F.col("raw_content_hash").isNotNull()).select(
        "site_id", "discovered_at", "id", "raw_content_hash"
    )
    order = [F.asc("discovered_at"), F.asc("id")]
    compared = exact_lag(seen, ["site_id"], order, "raw_content_hash", "before", parts)
    changed = F.col("before").isNotNull() & (F.col("before.v") != F.col("raw_content_hash"))
    return compared.groupBy("site_id").agg(
        F.count("*").alias("n_observations"),
        F.count_if(changed).alias("n_changes"),
        F.max(F.when(changed, F.col("discovered_at"))).alias("last_changed"),
    )


def resource_state(
    resources: DataFrame,
    log: DataFrame,
    as_of: datetime | str,
    lifetime_s: int = LIFETIME_S,
    healthy_age_s: int = LIFETIME_S,
    max_requests: int = MAX_REQUESTS,
) -> DataFrame:
    """State and health of every resource at `as_of` from its request log.

    A resource is born with its first request; age and request count must exceed
    their bound to count. `marked_dead` (optional, boolean) on resources wins. Dead
    is decided before degraded, and health has an age bound of its own.
    """
    now = ts(as_of)
    used = log.groupBy("resource_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_used"), F.count("*").alias("requests")
    )
    listed = resources.join(used, "resource_id", "left").withColumn("requests", F.coalesce("requests", F.lit(0)))
    marked = F.coalesce("marked_dead", F.lit(False)) if "marked_dead" in resources.columns else F.lit(False)

    def older_than(seconds: int) -> Column:
        edge = F.col("created_at") + F.make_dt_interval(secs=F.lit(seconds))
        return F.coalesce(now > edge, F.lit(False))

    busy = F.col("requests") > max_requests
    state = (
        F.when(marked | older_than(lifetime_s), "dead")
        .when(busy, "degraded")
        .when(F.col("requests") > 0, "active")
        .otherwise("fresh")
    )
    dead = F.col("state") == "dead"
    return listed.withColumn("state", state).withColumn("is_healthy", ~dead & ~older_than(healthy_age_s) & ~busy)


def resource_stats(states: DataFrame, rotated_at: datetime | str | None = None) -> DataFrame:
    """Total, active, healthy resources, and those used since the last rotation.

    Dead resources stay in the total; `active_resources` are all that are not dead.
    """
    in_use = F.col("last_used").isNotNull()
    if rotated_at is not None:
        in_use = F.coalesce(F.col("last_used") >= ts(rotated_at), F.lit(False))
    return states.agg(
        F.count("*").alias("total_resources"),
        F.count_if(F.col("state") != "dead").alias("active_resources"),
        F.count_if("is_healthy").alias("healthy_resources"),
        F.count_if(in_use).alias("sessions_cached"),
    )
