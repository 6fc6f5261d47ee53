"""The fixture tables seen as catalog tables, as frames and as the same SQL text.

The SQL is what the check runs; the frames are built from the same text, each
name in braces bound to a frame. Views named in SQL must be listed before use.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

AS_OF_SITES = "2000-12-31 00:00:00"
AS_OF_JOBS = "1999-01-01 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEW_SQL: dict[str, str] = {
    "sites": """
SELECT c.c_custkey AS site_id,
  concat(substr(translate(concat(md5(c.c_name), md5(c.c_name)), '0189', 'ghij'), 1,
    CASE WHEN c.c_custkey % 97 = 0 THEN 55 ELSE 56 END), '.onion') AS address,
  o.first_seen,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE o.last_seen END AS last_checked,
  CASE c.c_custkey % 6 WHEN 0 THEN 'discovered' WHEN 1 THEN 'active' WHEN 2 THEN 'inactive'
    WHEN 3 THEN 'dead' WHEN 4 THEN 'honeypot' ELSE 'scam' END AS status,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'forum' WHEN 'BUILDING' THEN 'market'
    WHEN 'FURNITURE' THEN 'library' WHEN 'HOUSEHOLD' THEN 'blog' END AS category,
  (c.c_acctbal + 1000) / 11000 AS risk_score,
  CASE c.c_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' END AS language,
  concat(c.c_mktsegment, ' ', CAST(c.c_custkey % 400 AS STRING)) AS title,
  CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE c.c_name END AS description,
  CASE WHEN c.c_custkey % 11 = 0 THEN true WHEN c.c_custkey % 13 = 0 THEN NULL ELSE false END AS is_honeypot,
  c.c_custkey % 17 = 0 AS is_illegal,
  split(concat(lower(c.c_mktsegment), ',t', CAST(c.c_custkey % 10 AS STRING)), ',') AS tags
FROM customer c
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen
           FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    "crawl_jobs": """
SELECT o_orderkey AS job_id, o_custkey AS site_id,
  concat('http://host', CAST(o_custkey % 50 AS STRING), '.example.org/', CAST(o_orderkey AS STRING)) AS url,
  5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
  CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'running'
    WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'failed' END AS status,
  CAST(o_orderkey % 5 AS INT) AS retry_count, 3 AS max_retries,
  o_orderdate AS created_at,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderdate END AS scheduled_for
FROM orders""",
    "job_events": """
SELECT l_orderkey AS job_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
  l_shipdate AS ts,
  CASE WHEN l_linenumber = 7 THEN 'retry' WHEN l_linenumber % 4 = 0 THEN 'pending'
    WHEN l_linenumber % 4 = 1 THEN 'running' WHEN l_linenumber % 4 = 2 THEN 'completed'
    ELSE 'failed' END AS status,
  CASE WHEN l_returnflag = 'R' THEN 'timeout' WHEN l_returnflag = 'A' THEN '' END AS error_message,
  CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS INT) END AS discovered_links
FROM lineitem""",
    "site_updates": """
SELECT e.event_id AS seq,
  CASE WHEN e.event_id % 50 = 0
    THEN concat(substr(translate(concat(md5(concat('new', CAST(e.user_id AS STRING))), md5(concat('new', CAST(e.user_id AS STRING)))), '0189', 'ghij'), 1, 56), '.onion')
    ELSE s.address END AS address,
  CASE e.event_type WHEN 'view' THEN 'active' WHEN 'error' THEN 'inactive' END AS status,
  CASE WHEN e.event_type = 'click' THEN concat('title ', CAST(e.event_id AS STRING)) END AS title,
  CASE WHEN e.event_type = 'purchase' THEN least(e.value / 100, 1.0) END AS risk_score
FROM events e JOIN sites s ON s.site_id = e.user_id""",
    "discovery_results": """
SELECT event_id AS id, user_id AS site_id,
  CASE event_type WHEN 'signup' THEN 'seed' WHEN 'view' THEN 'crawl' WHEN 'click' THEN 'directory'
    WHEN 'purchase' THEN 'social' ELSE 'api' END AS discovery_method,
  least(value / 100, 1.0) AS confidence,
  md5(event_type) AS raw_content_hash, ts AS discovered_at
FROM events""",
    "classifications": """
SELECT event_id AS id, user_id AS site_id,
  CASE event_id % 8 WHEN 0 THEN 'forum' WHEN 1 THEN 'market' WHEN 2 THEN 'service' WHEN 3 THEN 'library'
    WHEN 4 THEN 'blog' WHEN 5 THEN 'mirror' WHEN 6 THEN 'hidden_service' ELSE 'other' END AS category,
  least(value / 100, 1.0) AS confidence, 'v1' AS model_version,
  CASE event_id % 4 WHEN 0 THEN 'rule_based' WHEN 1 THEN 'ml_supervised' WHEN 2 THEN 'ml_unsupervised'
    ELSE 'hybrid' END AS model_type,
  props AS features, ts AS classified_at
FROM events""",
    "safety_checks": """
SELECT l.doc_id AS id, l.doc_id % 100 AS site_id, l.toxic = 0 AND l.quality = 1 AS is_safe,
  CASE WHEN l.toxic = 1 AND l.quality = 0 THEN 'quarantine' WHEN l.toxic = 1 THEN 'block'
    WHEN l.quality = 0 THEN 'review' ELSE 'allow' END AS action_taken,
  CASE WHEN l.toxic = 1 AND l.quality = 0 THEN split('toxic,low_quality', ',')
    WHEN l.toxic = 1 THEN split('toxic', ',') WHEN l.quality = 0 THEN split('low_quality', ',') END AS risk_factors,
  o.o_orderdate AS checked_at
FROM labels l JOIN orders o ON o.o_orderkey = l.doc_id""",
    "content_hashes": """
SELECT d.doc_id AS id, d.doc_id % 100 AS site_id,
  CASE WHEN d.doc_id % 2 = 0 THEN 'title' ELSE 'document' END AS hash_type,
  md5(d.text) AS hash_value, 'md5' AS algorithm, d.n_chars AS content_size,
  o.o_orderdate AS created_at
FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id""",
    "request_log": """
SELECT event_id AS request_id, user_id AS resource_id, ts,
  event_type = 'error' AS is_error, value AS response_time
FROM events""",
    "audit_logs": """
SELECT event_id AS id,
  CASE WHEN event_type IN ('view', 'click') THEN 'discovery' WHEN event_type = 'error' THEN 'safety' ELSE 'classification' END AS component,
  event_type AS action,
  CASE WHEN event_type = 'error' THEN 'failure' WHEN value > 100 THEN 'warning' ELSE 'success' END AS status,
  props AS details, ts AS created_at
FROM events""",
    "edges": """
SELECT DISTINCT o_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) AS dst FROM orders""",
    "known_honeypots": """
SELECT s.address FROM sites s JOIN supplier p ON p.s_suppkey * 7 = s.site_id""",
    # lines of a seed list: comments, blanks, known sites and addresses not known yet
    "seed_lines": """
SELECT site_id AS line_no,
  CASE WHEN site_id % 10 = 0 THEN concat('# ', title) WHEN site_id % 10 = 1 THEN ' '
    WHEN site_id % 10 = 2 THEN concat('http://', substr(translate(concat(md5(concat('seed', title)), md5(concat('seed', title))), '0189', 'ghij'), 1, 56), '.onion')
    ELSE concat(' http://', address, '/index ') END AS value
FROM sites""",
    # the link table by address; every tenth target is not in the catalog
    "site_links": """
SELECT a.address AS src_address,
  concat('http://', CASE WHEN e.dst % 10 = 0
    THEN concat(substr(translate(concat(md5(concat('new', b.title)), md5(concat('new', b.title))), '0189', 'ghij'), 1, 56), '.onion')
    ELSE b.address END, '/p', CAST(e.src % 90 AS STRING)) AS url
FROM edges e JOIN sites a ON a.site_id = e.src JOIN sites b ON b.site_id = e.dst""",
}

# The streamed and batch fold only compares positions, so the order columns
# themselves serve as the sequence and no window over the events is needed.
_SEQ = re.compile(r"row_number\(\) OVER \(PARTITION BY l_orderkey ORDER BY ([^)]*)\) AS seq")


def _spark_text(name: str) -> str:
    return _SEQ.sub(r"struct(\1) AS seq", VIEW_SQL[name])


@cache
def _needs(name: str) -> tuple[str, ...]:
    """Base tables and views that a view's text reads."""
    text = VIEW_SQL[name]
    return tuple(
        n for n in (*BASE, *VIEW_SQL) if n != name and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)
    )


_SCHEMAS: dict[str, StructType] = {}


class Fixture:
    """Frames over one folder of fixture tables; each is built when asked for."""

    def __init__(self, spark: SparkSession, folder: str, overrides: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.folder = folder
        self._frames: dict[str, DataFrame] = dict(overrides or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and name not in VIEW_SQL):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._base(name) if name in BASE else self._view(name)
        return self._frames[name]

    def _base(self, name: str) -> DataFrame:
        """A fixture table; its schema is read from the file once per process."""
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def _view(self, name: str) -> DataFrame:
        text = _spark_text(name)
        parts = {n: getattr(self, n) for n in _needs(name)}
        for part in parts:
            text = re.sub(rf"\b(FROM|JOIN)\s+{part}\b", rf"\1 {{{part}}}", text)
        return self.spark.sql(text, **parts)

    @property
    def resources(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("resource_id"))


def with_views(body: str, *extra: str) -> str:
    """`body` with a WITH clause for the views it reads (and those they read)."""
    wanted: set[str] = set(extra)

    def visit(name: str) -> None:
        wanted.add(name)
        for part in _needs(name):
            if part in VIEW_SQL:
                visit(part)

    for name in VIEW_SQL:
        if name in wanted or re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", body):
            visit(name)
    views = [f"{name} AS ({VIEW_SQL[name].strip()})" for name in VIEW_SQL if name in wanted]
    body = body.strip()
    if not views:
        return body
    keyword = "WITH RECURSIVE" if body.upper().startswith("WITH RECURSIVE") else "WITH"
    if body.upper().startswith("WITH RECURSIVE"):
        return f"{keyword} " + ",\n".join(views) + ",\n" + body[len("WITH RECURSIVE"):].strip()
    if body.upper().startswith("WITH"):
        return f"{keyword} " + ",\n".join(views) + ",\n" + body[len("WITH"):].strip()
    return f"{keyword} " + ",\n".join(views) + "\n" + body
