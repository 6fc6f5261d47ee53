"""Queries over the site catalog, its validation and its writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sitelode.functions.scalars import has_all_tags, has_any_tag, json_feature, json_variant, risk_bucket, status_normalize, title_hash, variant_value
from sitelode.operators import catalog, quality, search
from sitelode.operators.metrics import request_metrics
from sitelode.plans.discovery import append_discoveries
from sitelode.plans.registry import query
from sitelode.plans.views import AS_OF_EVENTS, AS_OF_SITES, Fixture
from sitelode.schema import TABLES
from sitelode.session import scratch_path
from sitelode.sources import catalog_io

SITES, EVENTS = f"TIMESTAMP '{AS_OF_SITES}'", f"TIMESTAMP '{AS_OF_EVENTS}'"


#: Columns of the fixture views, and the SQL of the two tables that are not views as they stand.
FIXTURE_COLUMNS = {
    "sites": "site_id address first_seen last_checked status category risk_score language title description is_honeypot is_illegal tags title_hash",
    "discovery_results": "id site_id discovery_method confidence raw_content_hash discovered_at",
    "classifications": "id site_id category confidence model_version model_type features classified_at",
    "safety_checks": "id site_id is_safe action_taken risk_factors checked_at",
    "crawl_jobs": "job_id site_id url priority status retry_count max_retries created_at scheduled_for",
    "content_hashes": "id site_id hash_type hash_value algorithm content_size created_at",
    "system_metrics": "id requests_per_minute error_rate avg_response_time timestamp",
    "audit_logs": "id component action status details created_at",
}
TITLED = "(SELECT *, sha256(title) AS title_hash FROM sites)"
TITLED_LONG = "(SELECT *, concat(sha256(title), coalesce(language, '')) AS title_hash FROM sites)"
HOURLY = "(SELECT DISTINCT date_trunc('hour', ts) AS id, date_trunc('hour', ts) AS timestamp FROM request_log)"
REPORTED = "(SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'failure' ELSE event_type END AS status FROM events)"


def _declared_columns():
    """(table, declared column) for every declared column that the fixture has."""
    return [(n, c) for n, t in TABLES.items() for c in t.columns if c.name in FIXTURE_COLUMNS[n].split()]


def _all(frames):
    return reduce(DataFrame.unionByName, frames)


def _catalog_tables(fx: Fixture):
    """All eight catalog tables, filled up to their declared columns."""
    return {n: quality.fill_defaults(f, n, AS_OF_EVENTS, add_missing=True) for n, f in _fixture_tables(fx).items()}


def _fixture_tables(fx: Fixture):
    """All eight catalog tables with the columns and nulls they have."""
    hourly = request_metrics(fx.request_log).select(
        F.xxhash64("bucket_start").alias("id"), "requests_per_minute", "error_rate", "avg_response_time",
        F.col("bucket_start").alias("timestamp"),
    )
    return {
        "sites": fx.sites.withColumn("title_hash", title_hash("title")),
        "discovery_results": fx.discovery_results,
        "classifications": fx.classifications,
        "safety_checks": fx.safety_checks,
        "crawl_jobs": fx.crawl_jobs,
        "content_hashes": fx.content_hashes,
        "system_metrics": hourly,
        "audit_logs": fx.audit_logs,
    }


@query(
    "load_catalog",
    """
SELECT 'sites' AS table_name, count(*) AS n_rows, count(DISTINCT site_id) AS n_keys FROM sites
UNION ALL SELECT 'discovery_results', count(*), count(DISTINCT id) FROM discovery_results
UNION ALL SELECT 'classifications', count(*), count(DISTINCT id) FROM classifications
UNION ALL SELECT 'safety_checks', count(*), count(DISTINCT id) FROM safety_checks
UNION ALL SELECT 'crawl_jobs', count(*), count(DISTINCT job_id) FROM crawl_jobs
UNION ALL SELECT 'content_hashes', count(*), count(DISTINCT id) FROM content_hashes
UNION ALL SELECT 'system_metrics', count(DISTINCT date_trunc('hour', ts)), count(DISTINCT date_trunc('hour', ts)) FROM request_log
UNION ALL SELECT 'audit_logs', count(*), count(DISTINCT id) FROM audit_logs""",
)
def load_catalog(fx: Fixture):
    root = scratch_path(fx.spark, "catalog")
    catalog_io.write_atomic(fx.spark, root, _catalog_tables(fx))
    counts = None
    for name, frame in catalog_io.load_catalog(fx.spark, root, key_type="bigint").items():
        part = frame.agg(F.count("*").alias("n_rows"), F.count_distinct(TABLES[name].key).alias("n_keys"))
        part = part.select(F.lit(name).alias("table_name"), "n_rows", "n_keys")
        counts = part if counts is None else counts.unionByName(part)
    return counts


@query(
    "write_atomic",
    """
SELECT 'crawl_jobs' AS table_name, job_id AS id, status FROM crawl_jobs UNION ALL SELECT 'sites', site_id, status FROM sites""",
)
def write_atomic(fx: Fixture):
    """Two versions: the second replaces the sites and leaves the jobs as they were."""
    root = scratch_path(fx.spark, "versions")
    early = fx.sites.withColumn("status", F.lit("discovered"))
    catalog_io.write_atomic(fx.spark, root, {"crawl_jobs": fx.crawl_jobs, "sites": early})
    catalog_io.write_atomic(fx.spark, root, {"sites": fx.sites})
    jobs, sites = (catalog_io.read_current(fx.spark, root, n) for n in ("crawl_jobs", "sites"))
    rows = jobs.select(F.lit("crawl_jobs").alias("table_name"), F.col("job_id").alias("id"), "status")
    return rows.unionByName(sites.select(F.lit("sites").alias("table_name"), F.col("site_id").alias("id"), "status"))


@query("layout_by_address", "SELECT site_id, address, status FROM sites")
def layout_by_address(fx: Fixture):
    return _address_layout(fx).select("site_id", "address", "status")


def _address_layout(fx: Fixture):
    path = scratch_path(fx.spark, "by-address")
    catalog_io.write_address_layout(fx.sites, path, int(fx.spark.conf.get("spark.sql.shuffle.partitions")))
    return fx.spark.read.parquet(path)


@query(
    "address_lookup",
    "SELECT site_id, address, status FROM sites WHERE address IN (SELECT address FROM known_honeypots)",
)
def address_lookup(fx: Fixture):
    """The sites of a list of addresses, out of the sorted layout."""
    return catalog_io.lookup_addresses(_address_layout(fx), fx.known_honeypots).select("site_id", "address", "status")


@query(
    "site_by_id",
    """
SELECT d.doc_id AS site_id, s.address, s.status, s.last_checked
FROM documents d LEFT JOIN sites s ON s.site_id = d.doc_id""",
)
def site_by_id(fx: Fixture):
    keys = fx.documents.select(F.col("doc_id").alias("site_id"))
    return catalog.site_by_id(fx.sites, keys).select("site_id", "address", "status", "last_checked")


@query(
    "site_by_address",
    """
SELECT u.address, s.site_id, s.status
FROM (SELECT DISTINCT address FROM site_updates) u LEFT JOIN sites s ON s.address = u.address""",
)
def site_by_address(fx: Fixture):
    keys = fx.site_updates.select("address").distinct()
    return catalog.site_by_address(fx.sites, keys).select("address", "site_id", "status")


@query(
    "pending_sites",
    f"""
SELECT site_id, address, status, last_checked FROM sites
WHERE (last_checked IS NULL OR last_checked < {SITES} - INTERVAL 24 HOUR)
  AND status IN ('discovered', 'active') AND is_honeypot = false AND is_illegal = false
ORDER BY last_checked ASC NULLS FIRST, site_id LIMIT 100""",
)
def pending_sites(fx: Fixture):
    return catalog.pending_sites(fx.sites, AS_OF_SITES).select("site_id", "address", "status", "last_checked")


@query(
    "search_sites",
    """
SELECT site_id, address, title, last_checked FROM sites
WHERE (title ILIKE '%ing 1%' OR description ILIKE '%ing 1%' OR address ILIKE '%ing 1%')
  AND category = 'market'
ORDER BY last_checked DESC NULLS FIRST, site_id LIMIT 40 OFFSET 5""",
)
def search_sites(fx: Fixture):
    found = catalog.search_sites(fx.sites, "ing 1", category="market", status="", limit=40, offset=5)
    return found.select("site_id", "address", "title", "last_checked")


@query(
    "search_batch",
    """
SELECT query_id, site_id, last_checked, rank FROM (
  SELECT q.query_id, s.site_id, s.last_checked,
    CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY s.last_checked DESC NULLS FIRST, s.site_id) AS INT) AS rank
  FROM (SELECT s_suppkey AS query_id,
          CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS STRING) ELSE concat('ing_', CAST(s_suppkey AS STRING)) END AS query
        FROM supplier) q
  JOIN sites s ON s.title ILIKE concat('%', q.query, '%') OR s.description ILIKE concat('%', q.query, '%')
    OR s.address ILIKE concat('%', q.query, '%')) r
WHERE rank <= 20""",
)
def search_batch(fx: Fixture):
    number = F.col("s_suppkey").cast("string")
    wanted = F.when(F.col("s_suppkey") % 2 == 0, number).otherwise(F.concat(F.lit("ing_"), number))
    queries = fx.supplier.select(F.col("s_suppkey").alias("query_id"), wanted.alias("query"))
    return search.search_batch(fx.sites, queries, limit=20)


_TEXTS_SQL = " UNION ALL ".join(f"SELECT row, '{c}' AS field, lower({c}) AS text FROM (SELECT *, row_number() OVER () AS row FROM sites) x WHERE {c} IS NOT NULL" for c in search.SEARCHED)
_PIECES_SQL = " UNION ALL ".join(
    f"SELECT row, field, unnest(list_transform(range(1, length(text) - {n - 2}), lambda i: substr(text, CAST(i AS BIGINT), {n}))) AS piece FROM texts" for n in range(1, search.GRAM + 1)
)


@query(
    "search_pieces",
    f"""
WITH texts AS ({_TEXTS_SQL})
SELECT piece, count(*) AS n FROM (SELECT DISTINCT row, field, piece FROM (SELECT row, field, '' AS piece FROM texts UNION ALL {_PIECES_SQL}) p) d GROUP BY piece""",
)
def search_pieces(fx: Fixture):
    """How many texts of the catalog hold each piece, from a written search index."""
    return search.build_search_index(fx.sites, scratch_path(fx.spark, "search")).counts


@query(
    "address_validate",
    """
SELECT site_id, address, CASE WHEN NOT suffix(address, '.onion') THEN 'address must end with .onion'
  WHEN length(address) <> 62 THEN 'invalid address length' END AS error FROM sites""",
)
def address_validate(fx: Fixture):
    return quality.address_validate(fx.sites).select("site_id", "address", "error")


@query("range_check", "SELECT event_id AS id, value / 100 AS value, 'range' AS problem FROM events WHERE value / 100 > 1 OR value < 0")
def range_check(fx: Fixture):
    rows = fx.events.select(F.col("event_id").alias("id"), (F.col("value") / 100).alias("confidence"))
    return quality.range_check(rows, "confidence", "id")


@query(
    "domain_check",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{c.name}' AS column_name, {c.name} AS value, count(*) AS n FROM {REPORTED if n == 'audit_logs' else n} t "
        f"WHERE {c.name} NOT IN ({', '.join(repr(v) for v in c.domain)}) GROUP BY {c.name}"
        for n, c in _declared_columns() if c.domain
    ),
)
def domain_check(fx: Fixture):
    """All declared domains; audit rows carry the event types as reported."""
    status = F.when(F.col("event_type") == "error", "failure").otherwise(F.col("event_type"))
    tables = _fixture_tables(fx) | {"audit_logs": fx.events.select(F.col("event_id").alias("id"), status.alias("status"))}
    return _all(quality.domain_check(f, n) for n, f in tables.items())


@query(
    "not_null_check",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{c.name}' AS column_name, count(*) - count({c.name}) AS n FROM {HOURLY if n == 'system_metrics' else n} t"
        for n, c in _declared_columns() if c.required
    ),
)
def not_null_check(fx: Fixture):
    return _all(quality.not_null_check(f, n) for n, f in _fixture_tables(fx).items())


@query(
    "length_check",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{c.name}' AS column_name, count(*) FILTER (WHERE length({c.name}) > {c.max_len}) AS n "
        f"FROM {TITLED_LONG if n == 'sites' else n} t"
        for n, c in _declared_columns() if c.max_len
    ),
)
def length_check(fx: Fixture):
    """All declared lengths; the title hash with the language behind it is too long."""
    hashed = F.concat(title_hash("title"), F.coalesce("language", F.lit("")))
    tables = _fixture_tables(fx) | {"sites": fx.sites.withColumn("title_hash", hashed)}
    return _all(quality.length_check(f, n) for n, f in tables.items())


@query(
    "unique_check",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{','.join(key)}' AS key_columns, count(*) AS n_keys FROM (SELECT 1 FROM "
        f"{TITLED if n == 'sites' else HOURLY if n == 'system_metrics' else n} t WHERE {' AND '.join(f'{k} IS NOT NULL' for k in key)} "
        f"GROUP BY {', '.join(key)} HAVING count(*) > 1) g"
        for n, t in TABLES.items() for key in ((t.key,), *t.unique)
    ),
)
def unique_check(fx: Fixture):
    return _all(quality.declared_unique_check(f, n) for n, f in _fixture_tables(fx).items())


@query(
    "orphan_check",
    """
WITH refs AS (
  SELECT 'discovery_results' AS table_name, CASE WHEN site_id % 97 = 0 THEN site_id + 100000000 ELSE site_id END AS site_id FROM discovery_results
  UNION ALL SELECT 'classifications', CASE WHEN site_id % 97 = 0 THEN site_id + 100000000 ELSE site_id END FROM classifications
  UNION ALL SELECT 'safety_checks', CASE WHEN site_id % 97 = 0 THEN site_id + 100000000 ELSE site_id END FROM safety_checks
  UNION ALL SELECT 'crawl_jobs', CASE WHEN site_id % 97 = 0 THEN site_id + 100000000 ELSE site_id END FROM crawl_jobs
  UNION ALL SELECT 'content_hashes', CASE WHEN site_id % 97 = 0 THEN site_id + 100000000 ELSE site_id END FROM content_hashes)
SELECT table_name, site_id, count(*) AS n FROM refs
WHERE site_id NOT IN (SELECT site_id FROM sites) GROUP BY table_name, site_id""",
)
def orphan_check(fx: Fixture):
    moved = F.when(F.col("site_id") % 97 == 0, F.col("site_id") + 100000000).otherwise(F.col("site_id"))
    names = ("discovery_results", "classifications", "safety_checks", "crawl_jobs", "content_hashes")
    return quality.orphan_check(fx.sites, {n: getattr(fx, n).withColumn("site_id", moved) for n in names})


@query(
    "fill_defaults",
    f"""
SELECT site_id, coalesce(first_seen, {SITES}) AS first_seen, status, risk_score, 'low' AS risk_level,
  coalesce(is_honeypot, false) AS is_honeypot, false AS requires_review, is_illegal, last_checked
FROM sites""",
)
def fill_defaults(fx: Fixture):
    return quality.fill_defaults(fx.sites, "sites", AS_OF_SITES, add_missing=True).select(
        "site_id", "first_seen", "status", "risk_score", "risk_level", "is_honeypot", "requires_review", "is_illegal", "last_checked"
    )


@query(
    "status_normalize",
    """
SELECT site_id, CASE WHEN status = 'dead' THEN 'discovered' ELSE status END AS status FROM sites""",
)
def status_normalized(fx: Fixture):
    reported = F.when(F.col("status") == "dead", "unknown").otherwise(F.col("status"))
    return fx.sites.select("site_id", status_normalize(reported).alias("status"))


@query("unclassified_sites", "SELECT site_id, address FROM sites WHERE category IS NULL")
def unclassified_sites(fx: Fixture):
    return catalog.unclassified_sites(fx.sites).select("site_id", "address")


@query(
    "site_upsert",
    f"""
WITH u AS (
  SELECT address, count(*) AS n,
    arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status,
    arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title,
    arg_max(risk_score, seq) FILTER (WHERE risk_score IS NOT NULL) AS risk_score
  FROM site_updates GROUP BY address)
SELECT coalesce(s.site_id, CAST(concat('0x', substr(sha256(u.address), 1, 15)) AS BIGINT)) AS site_id, coalesce(s.address, u.address) AS address,
  CASE WHEN s.address IS NULL THEN {SITES} ELSE s.first_seen END AS first_seen,
  CASE WHEN u.address IS NULL THEN s.last_checked WHEN s.address IS NOT NULL OR u.n > 1 THEN {SITES} END AS last_checked,
  coalesce(u.status, CASE WHEN s.address IS NULL THEN 'discovered' ELSE s.status END) AS status,
  coalesce(u.title, s.title) AS title,
  round(coalesce(u.risk_score, CASE WHEN s.address IS NULL THEN 0.0 ELSE s.risk_score END), 6) AS risk_score,
  CASE WHEN s.address IS NULL THEN false ELSE s.is_honeypot END AS is_honeypot
FROM sites s FULL OUTER JOIN u ON s.address = u.address""",
)
def site_upsert(fx: Fixture):
    merged = catalog.site_upsert(fx.sites, fx.site_updates, AS_OF_SITES)
    return merged.select(
        "site_id", "address", "first_seen", "last_checked", "status", "title",
        F.round("risk_score", 6).alias("risk_score"), "is_honeypot",
    )


@query(
    "children_with_site",
    """
SELECT r.id, r.discovery_method, s.address AS site_address, s.status AS site_status
FROM discovery_results r JOIN sites s ON s.site_id = r.site_id""",
)
def children_with_site(fx: Fixture):
    joined = catalog.children_with_site(fx.discovery_results, fx.sites)
    return joined.select("id", "discovery_method", "site_address", "site_status")


@query(
    "site_children",
    """
SELECT s.site_id, s.address,
  coalesce(d.n, 0) AS n_discoveries, d.at AS last_discoveries, coalesce(c.n, 0) AS n_classifications, c.at AS last_classifications,
  coalesce(k.n, 0) AS n_checks, k.at AS last_checks, coalesce(j.n, 0) AS n_jobs, j.at AS last_jobs
FROM sites s
LEFT JOIN (SELECT site_id, count(*) AS n, max(discovered_at) AS at FROM discovery_results GROUP BY site_id) d ON d.site_id = s.site_id
LEFT JOIN (SELECT site_id, count(*) AS n, max(classified_at) AS at FROM classifications GROUP BY site_id) c ON c.site_id = s.site_id
LEFT JOIN (SELECT site_id, count(*) AS n, max(checked_at) AS at FROM safety_checks GROUP BY site_id) k ON k.site_id = s.site_id
LEFT JOIN (SELECT site_id, count(*) AS n, max(created_at) AS at FROM crawl_jobs GROUP BY site_id) j ON j.site_id = s.site_id""",
)
def site_children(fx: Fixture):
    return catalog.site_children(fx.sites, fx.discovery_results, fx.classifications, fx.safety_checks, fx.crawl_jobs)


@query(
    "cascade_delete",
    """
WITH gone AS (SELECT site_id FROM sites WHERE status = 'dead' AND site_id NOT IN (SELECT site_id FROM content_hashes))
SELECT 'sites' AS table_name, count(*) AS n_left FROM sites WHERE site_id NOT IN (SELECT site_id FROM gone)
UNION ALL SELECT 'discovery_results', count(*) FROM discovery_results WHERE site_id NOT IN (SELECT site_id FROM gone)
UNION ALL SELECT 'classifications', count(*) FROM classifications WHERE site_id NOT IN (SELECT site_id FROM gone)
UNION ALL SELECT 'safety_checks', count(*) FROM safety_checks WHERE site_id NOT IN (SELECT site_id FROM gone)
UNION ALL SELECT 'crawl_jobs', count(*) FROM crawl_jobs WHERE site_id NOT IN (SELECT site_id FROM gone)
UNION ALL SELECT 'content_hashes', count(*) FROM content_hashes
UNION ALL SELECT 'refused', count(*) FROM sites WHERE status = 'dead' AND site_id IN (SELECT site_id FROM content_hashes)""",
)
def cascade_delete(fx: Fixture):
    names = ("sites", "discovery_results", "classifications", "safety_checks", "crawl_jobs", "content_hashes")
    tables = {n: getattr(fx, n) for n in names}
    remaining, refused = catalog.cascade_delete(tables, fx.sites.filter("status = 'dead'"))
    counts = None
    for name, frame in {**remaining, "refused": refused}.items():
        part = frame.agg(F.count("*").alias("n_left")).select(F.lit(name).alias("table_name"), "n_left")
        counts = part if counts is None else counts.unionByName(part)
    return counts


@query(
    "honeypot_flag",
    """
SELECT site_id, address, address IN (SELECT address FROM known_honeypots) AS known_honeypot FROM sites""",
)
def honeypot_flag(fx: Fixture):
    return catalog.honeypot_flag(fx.sites, fx.known_honeypots).select("site_id", "address", "known_honeypot")


@query(
    "new_addresses",
    "SELECT DISTINCT address FROM site_updates WHERE address NOT IN (SELECT address FROM sites)",
)
def new_addresses(fx: Fixture):
    return catalog.new_addresses(fx.site_updates, fx.sites)


@query(
    "append_discoveries",
    f"""
SELECT sha256(concat_ws(chr(31), CAST(site_id AS VARCHAR), discovery_method, coalesce(CAST(id AS VARCHAR), ''), '{AS_OF_EVENTS}')) AS id,
  site_id, CAST(id AS VARCHAR) AS source_url, discovery_method, coalesce(CASE WHEN discovery_method = 'api' THEN NULL ELSE confidence END, 0.0) AS confidence,
  CAST(NULL AS DOUBLE) AS processing_time, {EVENTS} AS discovered_at
FROM discovery_results""",
)
def append_discovery_rows(fx: Fixture):
    found = fx.discovery_results.select(
        "site_id", "discovery_method", F.col("id").cast("string").alias("source_url"),
        F.when(F.col("discovery_method") != "api", F.col("confidence")).alias("confidence"),
    )
    return append_discoveries(found, AS_OF_EVENTS).select(
        "id", "site_id", "source_url", "discovery_method", "confidence", "processing_time", "discovered_at"
    )


@query(
    "export_json",
    """
SELECT concat('{"job_id":', job_id, ',"url":"', url, '","status":"', status, '","created_at":"',
  strftime(created_at, '%Y-%m-%dT%H:%M:%S'), '","scheduled_for":',
  CASE WHEN scheduled_for IS NULL THEN 'null' ELSE concat('"', strftime(scheduled_for, '%Y-%m-%dT%H:%M:%S'), '"') END, '}') AS json
FROM crawl_jobs""",
)
def export_json(fx: Fixture):
    return catalog_io.json_lines(fx.crawl_jobs.select("job_id", "url", "status", "created_at", "scheduled_for"))


@query("title_hash", "SELECT site_id, sha256(title) AS title_hash FROM sites")
def title_hashes(fx: Fixture):
    return fx.sites.select("site_id", title_hash("title").alias("title_hash"))


@query(
    "json_typed",
    """
SELECT id, TRY_CAST(json_extract_string(features, '$.k') AS BIGINT) AS k, json_extract_string(features, '$.k') AS k_text, json_valid(features) AS is_json
FROM classifications""",
)
def json_typed(fx: Fixture):
    """Typed values out of a JSON column, by the variant type."""
    value = json_variant("features")
    return fx.classifications.select(
        "id", variant_value(value, "$.k", "bigint").alias("k"), variant_value(value, "$.k", "string").alias("k_text"), value.isNotNull().alias("is_json")
    )


@query("json_features", "SELECT id, CAST(json_extract_string(features, '$.k') AS VARCHAR) AS k FROM classifications")
def json_features(fx: Fixture):
    return fx.classifications.select("id", json_feature("features", "$.k").alias("k"))


@query(
    "tag_filter",
    """
SELECT site_id, list_contains(tags, 'building') AND list_contains(tags, 't3') AS has_all,
  list_contains(tags, 'building') OR list_contains(tags, 't3') AS has_any
FROM sites WHERE list_contains(tags, 'building') OR list_contains(tags, 't3')""",
)
def tag_filter(fx: Fixture):
    wanted = ["building", "t3"]
    return fx.sites.filter(has_any_tag("tags", wanted)).select(
        "site_id", has_all_tags("tags", wanted).alias("has_all"), has_any_tag("tags", wanted).alias("has_any")
    )


@query(
    "risk_bucket",
    """
SELECT site_id, CASE WHEN risk_score < 0.25 THEN 'low' WHEN risk_score < 0.5 THEN 'medium'
  WHEN risk_score < 0.75 THEN 'high' WHEN risk_score IS NOT NULL THEN 'critical' END AS risk_level FROM sites""",
)
def risk_levels(fx: Fixture):
    return fx.sites.select("site_id", risk_bucket("risk_score").alias("risk_level"))
