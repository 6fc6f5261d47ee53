"""Queries over counts, rollups, logs and newest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.functions.scalars import risk_bucket, title_hash
from sitelode.operators import metrics, sketches
from sitelode.plans.registry import query
from sitelode.plans.views import AS_OF_EVENTS, Fixture
from sitelode.session import scratch_path

EVENTS = f"TIMESTAMP '{AS_OF_EVENTS}'"
LIFETIME_DAYS, REQUEST_LIMIT = 29, 60

STATES = f"""
  SELECT c.c_custkey AS resource_id, coalesce(l.n, 0) AS requests, l.last_used,
    CASE WHEN l.born IS NOT NULL AND l.born + INTERVAL {LIFETIME_DAYS} DAY < {EVENTS} THEN 'dead'
      WHEN l.n > {REQUEST_LIMIT} THEN 'degraded' WHEN l.n > 0 THEN 'active' ELSE 'fresh' END AS state
  FROM customer c LEFT JOIN (SELECT resource_id, min(ts) AS born, max(ts) AS last_used, count(*) AS n
                             FROM request_log GROUP BY resource_id) l ON l.resource_id = c.c_custkey"""


def _titled(fx: Fixture):
    return fx.sites.withColumn("title_hash", title_hash("title"))


MIRRORS = """
  SELECT sha256(title) AS title_hash, language, count(*) AS n_sites,
    min(first_seen) AS first_seen FROM sites WHERE title IS NOT NULL AND language IS NOT NULL
  GROUP BY 1, 2 HAVING count(*) > 1"""

CANONICAL = f"""
  SELECT g.title_hash, g.language, g.n_sites, g.first_seen, min(s.address) AS canonical_address
  FROM ({MIRRORS}) g JOIN sites s ON sha256(s.title) = g.title_hash AND s.language = g.language
    AND s.first_seen IS NOT DISTINCT FROM g.first_seen
  GROUP BY 1, 2, 3, 4"""


@query("mirror_groups", f"WITH m AS ({CANONICAL}) SELECT title_hash, language, n_sites, canonical_address, first_seen FROM m")
def mirror_groups(fx: Fixture):
    return metrics.mirror_groups(_titled(fx))


@query(
    "mirror_members",
    f"""
WITH m AS ({CANONICAL})
SELECT s.address, m.canonical_address FROM sites s JOIN m ON sha256(s.title) = m.title_hash AND s.language = m.language""",
)
def mirror_members(fx: Fixture):
    return metrics.mirror_members(_titled(fx))


@query(
    "catalog_counts",
    """
SELECT (SELECT count(*) FROM sites) AS sites_discovered, (SELECT count(category) FROM sites) AS sites_classified,
  (SELECT count(*) FROM safety_checks) AS safety_checks_performed""",
)
def catalog_counts(fx: Fixture):
    return metrics.catalog_counts(fx.sites, fx.safety_checks)


@query(
    "status_rollup",
    """
WITH leveled AS (
  SELECT status, category, CASE WHEN risk_score < 0.25 THEN 'low' WHEN risk_score < 0.5 THEN 'medium'
    WHEN risk_score < 0.75 THEN 'high' WHEN risk_score IS NOT NULL THEN 'critical' END AS risk_level FROM sites)
SELECT status, category, risk_level, CAST(0 AS BIGINT) AS grouping_id, count(*) AS n_sites FROM leveled GROUP BY 1, 2, 3
UNION ALL SELECT status, category, NULL, 1, count(*) FROM leveled GROUP BY 1, 2
UNION ALL SELECT status, NULL, NULL, 3, count(*) FROM leveled GROUP BY 1
UNION ALL SELECT NULL, NULL, NULL, 7, count(*) FROM leveled""",
)
def status_rollup(fx: Fixture):
    return metrics.status_rollup(fx.sites.withColumn("risk_level", risk_bucket("risk_score")))


@query(
    "discovery_by_method",
    """
SELECT discovery_method, count(*) AS n_results, count(DISTINCT site_id) AS n_sites, round(avg(confidence), 6) AS mean_confidence
FROM discovery_results GROUP BY discovery_method""",
)
def discovery_by_method(fx: Fixture):
    return metrics.discovery_by_method(fx.discovery_results).withColumn(
        "mean_confidence", F.round("mean_confidence", 6)
    )


@query(
    "discovery_sketches",
    """
SELECT discovery_method, count(*) AS n_results, count(DISTINCT site_id) AS n_sites, true AS within_error, round(avg(confidence), 6) AS mean_confidence
FROM discovery_results GROUP BY discovery_method""",
)
def discovery_sketches(fx: Fixture):
    """Sites per method from sketches stored by day, and whether the estimate is within four standard errors of the exact number."""
    path = scratch_path(fx.spark, "sketches")
    sketches.daily_sketches(fx.discovery_results).write.partitionBy("day").parquet(path)
    estimated = sketches.discovery_by_method_estimated(fx.spark.read.parquet(path)).withColumnRenamed("n_sites", "estimate")
    exact = metrics.discovery_by_method(fx.discovery_results).select("discovery_method", "n_sites")
    near = F.abs(F.col("estimate") - F.col("n_sites")) <= 4 * sketches.STANDARD_ERROR * F.col("n_sites")
    return estimated.join(exact, "discovery_method").select(
        "discovery_method", "n_results", "n_sites", near.alias("within_error"), F.round("mean_confidence", 6).alias("mean_confidence")
    )


@query(
    "request_metrics",
    """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, round(CAST(count(*) / 60.0 AS DOUBLE), 6) AS requests_per_minute,
  round(avg(CASE WHEN is_error THEN 1 ELSE 0 END), 6) AS error_rate, round(avg(response_time), 6) AS avg_response_time
FROM request_log GROUP BY 1""",
)
def request_metrics(fx: Fixture):
    rows = metrics.request_metrics(fx.request_log, 60)
    return rows.select(
        "bucket_start", *[F.round(c, 6).alias(c) for c in ("requests_per_minute", "error_rate", "avg_response_time")]
    )


@query(
    "audit_rollup",
    """
SELECT component, action, count(*) FILTER (WHERE status = 'success') AS success,
  count(*) FILTER (WHERE status = 'failure') AS failure, count(*) FILTER (WHERE status = 'warning') AS warning
FROM audit_logs GROUP BY component, action""",
)
def audit_rollup(fx: Fixture):
    return metrics.audit_rollup(fx.audit_logs)


@query(
    "audit_filter",
    """
SELECT 'action' AS path, id, created_at FROM audit_logs WHERE component = 'discovery' AND action = 'view'
UNION ALL
SELECT 'time', id, created_at FROM audit_logs
WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at < TIMESTAMP '2024-01-20 00:00:00' AND status = 'warning'""",
)
def audit_filter(fx: Fixture):
    by_action = metrics.audit_filter(fx.audit_logs, component="discovery", action="view")
    by_time = metrics.audit_filter(fx.audit_logs, since="2024-01-10 00:00:00", until="2024-01-20 00:00:00", status="warning")
    parts = [f.select(F.lit(p).alias("path"), "id", "created_at") for p, f in (("action", by_action), ("time", by_time))]
    return parts[0].unionByName(parts[1])


@query(
    "tag_counts",
    """
SELECT 'tags' AS source, tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM sites) t GROUP BY tag
UNION ALL SELECT 'risk_factors', tag, count(*) FROM (SELECT unnest(risk_factors) AS tag FROM safety_checks) t GROUP BY tag""",
)
def tag_counts(fx: Fixture):
    tags = metrics.tag_counts(fx.sites).select(F.lit("tags").alias("source"), "tag", "n")
    factors = metrics.tag_counts(fx.safety_checks, "risk_factors").select(F.lit("risk_factors").alias("source"), "tag", "n")
    return tags.unionByName(factors)


@query(
    "latest_classification",
    """
SELECT site_id, id, category, confidence, classified_at FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY classified_at DESC, id DESC) AS rn FROM classifications) r WHERE rn = 1""",
)
def latest_classification(fx: Fixture):
    return metrics.latest_classification(fx.classifications).select("site_id", "id", "category", "confidence", "classified_at")


@query(
    "latest_safety",
    """
SELECT site_id, id, action_taken, checked_at, action_taken = 'block' AS is_illegal, action_taken IN ('review', 'quarantine') AS requires_review
FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY checked_at DESC, id DESC) AS rn FROM safety_checks) r WHERE rn = 1""",
)
def latest_safety(fx: Fixture):
    return metrics.latest_safety(fx.safety_checks).select(
        "site_id", "id", "action_taken", "checked_at", "is_illegal", "requires_review"
    )


@query(
    "change_detect",
    """
WITH seen AS (
  SELECT site_id, discovered_at, raw_content_hash,
    lag(raw_content_hash) OVER (PARTITION BY site_id ORDER BY discovered_at, id) AS before
  FROM discovery_results WHERE raw_content_hash IS NOT NULL)
SELECT site_id, count(*) AS n_observations, count(*) FILTER (WHERE before <> raw_content_hash) AS n_changes,
  max(CASE WHEN before <> raw_content_hash THEN discovered_at END) AS last_changed
FROM seen GROUP BY site_id""",
)
def change_detect(fx: Fixture):
    return metrics.change_detect(fx.discovery_results)


def _states(fx: Fixture):
    seconds = LIFETIME_DAYS * 86400
    return metrics.resource_state(fx.resources, fx.request_log, AS_OF_EVENTS, seconds, seconds, REQUEST_LIMIT)


@query(
    "resource_state",
    f"""
WITH s AS ({STATES})
SELECT resource_id, requests, state, state <> 'dead' AND requests <= {REQUEST_LIMIT} AS is_healthy FROM s""",
)
def resource_state(fx: Fixture):
    return _states(fx).select("resource_id", "requests", "state", "is_healthy")


@query(
    "resource_stats",
    f"""
WITH s AS ({STATES})
SELECT count(*) AS total_resources, count(*) FILTER (WHERE state <> 'dead') AS active_resources,
  count(*) FILTER (WHERE state <> 'dead' AND requests <= {REQUEST_LIMIT}) AS healthy_resources,
  count(*) FILTER (WHERE last_used >= TIMESTAMP '2024-01-25 00:00:00') AS sessions_cached FROM s""",
)
def resource_stats(fx: Fixture):
    return metrics.resource_stats(_states(fx), rotated_at="2024-01-25 00:00:00")
