"""Queries over the runs that write findings back to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelode.functions.layout import spread_small
from sitelode.operators import bayes, metrics
from sitelode.plans import runs
from sitelode.plans.content_set import HELD_OUT, PATTERNS, SIMHASH, SIZE_LIMIT, SQL_FLAGS, _bayes_sql, _labelled
from sitelode.plans.discovery import by_bayes, classify_run
from sitelode.plans.registry import query
from sitelode.plans.views import AS_OF_EVENTS, AS_OF_SITES, Fixture

SITES, EVENTS = f"TIMESTAMP '{AS_OF_SITES}'", f"TIMESTAMP '{AS_OF_EVENTS}'"

SAFETY_CTES = f"""
d AS (SELECT doc_id % 100 AS site_id, text, {SQL_FLAGS} FROM documents),
trapped AS (SELECT s.site_id, coalesce(s.is_honeypot, false) AS own, s.address IN (SELECT address FROM known_honeypots) AS listed FROM sites s),
j AS (SELECT d.site_id, text, h_contact + h_address + h_licence > 0 AS flagged, octet_length(encode(text)) > {SIZE_LIMIT} AS big, own OR listed AS trap,
  concat_ws(',', CASE WHEN h_contact > 0 THEN 'Contact' END, CASE WHEN h_address > 0 THEN 'Address' END, CASE WHEN h_licence > 0 THEN 'Licence' END) AS flags
  FROM d JOIN trapped ON trapped.site_id = d.site_id),
checks AS (SELECT DISTINCT site_id, CASE WHEN flagged THEN 'block' WHEN big THEN 'quarantine' WHEN trap THEN 'review' ELSE 'allow' END AS action_taken,
  sha256(text) AS checked_content_hash, flags FROM j)"""


def _safety_run(fx: Fixture):
    contents = fx.documents.select((F.col("doc_id") % 100).alias("site_id"), "text")
    return runs.safety_run(
        fx.sites, contents, PATTERNS, AS_OF_SITES, max_bytes=SIZE_LIMIT, known_honeypots=fx.known_honeypots
    )


@query(
    "safety_run",
    f"""
WITH {SAFETY_CTES}
SELECT sha256(concat_ws(chr(31), CAST(site_id AS VARCHAR), checked_content_hash, '{runs.FILTER_VERSION}', '{AS_OF_SITES}')) AS id, site_id,
  action_taken = 'allow' AS is_safe, action_taken, flags AS flagged_categories, '{runs.FILTER_VERSION}' AS filter_version, checked_content_hash, {SITES} AS checked_at
FROM checks""",
)
def safety_run(fx: Fixture):
    """The check rows that a run over all documents adds, several contents to a site."""
    return _safety_run(fx).safety_checks.select(
        "id", "site_id", "is_safe", "action_taken", F.array_join("flagged_categories", ",").alias("flagged_categories"),
        "filter_version", "checked_content_hash", "checked_at",
    )


@query(
    "safety_run_sites",
    f"""
WITH {SAFETY_CTES},
worst AS (SELECT site_id, max(list_position(['allow', 'review', 'quarantine', 'block'], action_taken)) AS grade FROM checks GROUP BY site_id)
SELECT s.site_id, CASE WHEN grade = 4 THEN true ELSE s.is_illegal END AS is_illegal, coalesce(grade IN (2, 3), false) AS requires_review,
  CASE WHEN listed THEN true ELSE s.is_honeypot END AS is_honeypot
FROM sites s LEFT JOIN worst ON worst.site_id = s.site_id JOIN trapped ON trapped.site_id = s.site_id""",
)
def safety_run_sites(fx: Fixture):
    """The flags of the sites after the same run."""
    return _safety_run(fx).sites.select("site_id", "is_illegal", "requires_review", "is_honeypot")


@query(
    "classify_run_model",
    f"""
WITH {_bayes_sql("doc_id % 3 <> 2")},
found AS (SELECT s.site_id, j.category, j.confidence FROM judged j JOIN sites s ON s.site_id = j.doc_id WHERE s.category IS NULL)
SELECT s.site_id, CASE WHEN f.confidence >= 0.7 THEN f.category ELSE s.category END AS category, coalesce(NOT f.confidence >= 0.7, false) AS requires_review,
  f.category AS judged_category, round(f.confidence, 6) AS confidence, CASE WHEN f.site_id IS NOT NULL THEN 'ml_supervised' END AS model_type,
  CASE WHEN f.site_id IS NOT NULL THEN 'bayes-1' END AS model_version
FROM sites s LEFT JOIN found f ON f.site_id = s.site_id""",
)
def classification_by_model(fx: Fixture):
    """A classification run by the Bayes model in place of the rules."""
    documents = spread_small(fx.documents.select("doc_id", "text"), "doc_id")
    model = bayes.fit_bayes(documents.filter(f"NOT ({HELD_OUT})").join(_labelled(fx), "doc_id"))
    contents = documents.withColumnRenamed("doc_id", "site_id")
    run = classify_run(fx.sites, contents, AS_OF_SITES, classifier=by_bayes(model), model_type="ml_supervised", model_version="bayes-1")
    judged = run.classifications.select(
        "site_id", F.col("category").alias("judged_category"), F.round("confidence", 6).alias("confidence"), "model_type", "model_version"
    )
    return run.sites.select("site_id", "category", "requires_review").join(judged, "site_id", "left")


@query(
    "hash_run",
    f"""
WITH simhashes AS ({SIMHASH}),
contents AS (SELECT doc_id, doc_id % 100 AS site_id, concat(source, ' ', lang) AS title, text, TIMESTAMP '2000-01-01 00:00:00' + to_days(CAST(doc_id % 7 AS INT)) AS created_at FROM documents),
rows AS (
  SELECT site_id, created_at, 'title' AS hash_type, sha256(title) AS hash_value, 'sha256' AS algorithm, CAST(octet_length(encode(title)) AS INT) AS content_size FROM contents WHERE title IS NOT NULL
  UNION ALL SELECT site_id, created_at, 'document', sha256(text), 'sha256', CAST(octet_length(encode(text)) AS INT) FROM contents WHERE text IS NOT NULL
  UNION ALL SELECT site_id, created_at, 'text_simhash', format('{{:015x}}', simhash), 'simhash60-md5', CAST(octet_length(encode(text)) AS INT) FROM contents JOIN simhashes ON simhashes.doc_id = contents.doc_id),
old AS (SELECT CAST(id AS VARCHAR) AS id, site_id, hash_type, hash_value, algorithm, CAST(content_size AS INT) AS content_size, created_at FROM content_hashes),
fresh AS (SELECT sha256(concat_ws(chr(31), CAST(site_id AS VARCHAR), hash_type, hash_value, strftime(created_at, '%Y-%m-%d %H:%M:%S'))) AS id, site_id, hash_type, hash_value, algorithm, content_size, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, hash_type ORDER BY created_at DESC, hash_value DESC) AS rn FROM rows) r WHERE rn = 1)
SELECT id, site_id, hash_type, hash_value, algorithm, content_size, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, hash_type ORDER BY created_at DESC, id DESC) AS rn FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh) x) y WHERE rn = 1""",
)
def hash_run(fx: Fixture):
    """The hash table after the hashes of all documents, several contents to a site."""
    seen = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("doc_id") % 7).cast("int"))
    contents = fx.documents.select((F.col("doc_id") % 100).alias("site_id"), F.concat("source", F.lit(" "), "lang").alias("title"), "text", seen.alias("fetched_at"))
    columns = ("id", "site_id", "hash_type", "hash_value", "algorithm", "content_size", "created_at")
    old = fx.content_hashes.select(F.col("id").cast("string").alias("id"), *columns[1:5], F.col("content_size").cast("int").alias("content_size"), "created_at")
    return runs.hash_run(old, contents, AS_OF_SITES).select(*columns)


@query(
    "risk_run",
    """
WITH c AS (SELECT site_id, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY classified_at DESC, id DESC) AS rn FROM classifications) r WHERE rn = 1),
k AS (SELECT site_id, risk_factors, action_taken FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY checked_at DESC, id DESC) AS rn FROM safety_checks) r WHERE rn = 1),
scored AS (SELECT s.site_id, CASE WHEN c.site_id IS NULL AND k.site_id IS NULL THEN s.risk_score ELSE round(least(1.0, CASE WHEN k.action_taken = 'block' THEN 0.4 ELSE 0.0 END
    + 0.1 * coalesce(len(k.risk_factors), 0) + CASE WHEN s.is_honeypot THEN 0.3 ELSE 0.0 END + 0.2 * (1 - coalesce(c.confidence, 0.0))), 6) END AS risk_score,
    c.site_id IS NULL AND k.site_id IS NULL AS kept
  FROM sites s LEFT JOIN c ON c.site_id = s.site_id LEFT JOIN k ON k.site_id = s.site_id)
SELECT site_id, round(risk_score, 6) AS risk_score, CASE WHEN kept THEN 'low' WHEN risk_score < 0.25 THEN 'low' WHEN risk_score < 0.5 THEN 'medium' WHEN risk_score < 0.75 THEN 'high' ELSE 'critical' END AS risk_level
FROM scored""",
)
def risk_run(fx: Fixture):
    return runs.risk_run(fx.sites, fx.classifications, fx.safety_checks).select("site_id", F.round("risk_score", 6).alias("risk_score"), "risk_level")


@query(
    "change_run",
    """
WITH seen AS (SELECT site_id, discovered_at, raw_content_hash <> lag(raw_content_hash) OVER (PARTITION BY site_id ORDER BY discovered_at, id) AS changed
  FROM discovery_results WHERE raw_content_hash IS NOT NULL),
found AS (SELECT site_id, max(discovered_at) AS last_changed FROM seen WHERE changed GROUP BY site_id)
SELECT s.site_id, greatest(f.last_changed, s.first_seen) AS last_changed FROM sites s LEFT JOIN found f ON f.site_id = s.site_id""",
)
def change_run(fx: Fixture):
    """Sites whose last change is known so far as the day they were first seen."""
    sites = fx.sites.withColumn("last_changed", F.col("first_seen"))
    return runs.change_run(sites, fx.discovery_results).select("site_id", "last_changed")


@query(
    "metrics_snapshot",
    f"""
WITH recent AS (SELECT * FROM request_log WHERE ts >= {EVENTS} - INTERVAL 1440 MINUTE AND ts < {EVENTS}),
born AS (SELECT c.c_custkey, min(l.ts) AS created_at FROM customer c LEFT JOIN request_log l ON l.resource_id = c.c_custkey GROUP BY 1)
SELECT sha256(concat_ws(chr(31), 'system_metrics', '{AS_OF_EVENTS}')) AS id, CAST((SELECT count(*) FROM sites) AS INT) AS sites_discovered, CAST((SELECT count(category) FROM sites) AS INT) AS sites_classified,
  CAST((SELECT count(*) FROM safety_checks) AS INT) AS safety_checks_performed, CAST((SELECT count(*) FROM born) AS INT) AS circuits_total,
  CAST((SELECT count(*) FROM born WHERE created_at IS NULL OR {EVENTS} <= created_at + INTERVAL 600 SECOND) AS INT) AS circuits_active,
  round((SELECT count(*) FROM recent) / 1440.0, 6) AS requests_per_minute, round((SELECT avg(CASE WHEN is_error THEN 1 ELSE 0 END) FROM recent), 6) AS error_rate,
  round((SELECT avg(response_time) FROM recent), 6) AS avg_response_time, {EVENTS} AS "timestamp\"""",
)
def metrics_snapshot(fx: Fixture):
    states = metrics.resource_state(fx.resources, fx.request_log, AS_OF_EVENTS)
    row = runs.metrics_snapshot(fx.sites, fx.safety_checks, fx.request_log, states, AS_OF_EVENTS, minutes=1440)
    counts = ("sites_discovered", "sites_classified", "safety_checks_performed", "circuits_total", "circuits_active")
    return row.select("id", *counts, *[F.round(c, 6).alias(c) for c in ("requests_per_minute", "error_rate", "avg_response_time")], "timestamp")


@query(
    "audit_append",
    f"""
SELECT DISTINCT sha256(concat_ws(chr(31), 'crawler', status, CASE status WHEN 'failed' THEN 'failure' ELSE 'success' END, url, '{AS_OF_EVENTS}')) AS id, 'crawler' AS component, status AS action,
  CASE status WHEN 'failed' THEN 'failure' ELSE 'success' END AS status, url AS details, {EVENTS} AS created_at
FROM crawl_jobs WHERE status IN ('failed', 'completed')""",
)
def audit_append(fx: Fixture):
    """Audit entries for every job that ended."""
    ended = fx.crawl_jobs.filter(F.col("status").isin("failed", "completed"))
    status = F.when(F.col("status") == "failed", "failure").otherwise("success")
    entries = ended.select(F.lit("crawler").alias("component"), F.col("status").alias("action"), status.alias("status"), F.col("url").alias("details"))
    return runs.audit_rows(entries, AS_OF_EVENTS).select("id", "component", "action", "status", "details", "created_at")
