"""Declared tables: column types, required columns, defaults, value domains and lengths.

One declaration per table drives the loaders, the default filling and every
quality check, so the rules are written down once.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

KEY = "key"  # replaced by the key type of the catalog (string, or bigint in fixtures)


class Now:
    """Default that stands for the `as_of` time of the operation."""


NOW = Now()

# --- fixed values: value domains -------------------------------------------------
SITE_STATUS = ("discovered", "active", "inactive", "dead", "honeypot", "scam")
CATEGORY = ("forum", "market", "service", "library", "blog", "mirror", "hidden_service", "other")
RISK_LEVEL = ("low", "medium", "high", "critical")
DISCOVERY_METHOD = ("seed", "crawl", "directory", "social", "api")
MODEL_TYPE = ("rule_based", "ml_supervised", "ml_unsupervised", "hybrid")
SAFETY_ACTION = ("allow", "block", "review", "quarantine")
JOB_STATUS = ("pending", "running", "completed", "failed", "retry")
HASH_TYPE = ("title", "image_phash", "text_simhash", "document")
AUDIT_STATUS = ("success", "failure", "warning")
RESOURCE_STATE = ("fresh", "active", "degraded", "dead")

ADDRESS_SUFFIX = ".onion"
ADDRESS_LENGTH = 62


@dataclass(frozen=True)
class Col:
    """A declared column; `type` is a Spark DDL type or KEY."""

    name: str
    type: str = "string"
    required: bool = False
    default: Any = None
    domain: tuple[str, ...] | None = None
    max_len: int | None = None


@dataclass(frozen=True)
class Table:
    columns: tuple[Col, ...]
    key: str
    unique: tuple[tuple[str, ...], ...] = ()

    def column(self, name: str) -> Col:
        return next(c for c in self.columns if c.name == name)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


_TS = "timestamp_ntz"

# --- fixed values: the tables ------------------------------------------------------

TABLES: dict[str, Table] = {
    "sites": Table(
        key="site_id",
        unique=(("address",), ("title_hash", "language")),
        columns=(
            Col("site_id", KEY, required=True),
            Col("address", required=True),
            Col("first_seen", _TS, required=True, default=NOW),
            Col("last_checked", _TS),
            Col("last_changed", _TS),
            Col("status", required=True, default="discovered", domain=SITE_STATUS),
            Col("category", domain=CATEGORY),
            Col("subcategory", max_len=100),
            Col("risk_score", "double", default=0.0),
            Col("risk_level", default="low", domain=RISK_LEVEL),
            Col("language", max_len=10),
            Col("title"),
            Col("title_hash", max_len=64),
            Col("description"),
            Col("is_honeypot", "boolean", default=False),
            Col("requires_review", "boolean", default=False),
            Col("is_illegal", "boolean", default=False),
            Col("tags", "array<string>"),
            Col("metadata"),
        ),
    ),
    "discovery_results": Table(
        key="id",
        columns=(
            Col("id", KEY, required=True),
            Col("site_id", KEY, required=True),
            Col("source_url"),
            Col("discovery_method", required=True, domain=DISCOVERY_METHOD),
            Col("confidence", "double", default=0.0),
            Col("raw_content_hash", max_len=64),
            Col("processing_time", "double"),
            Col("discovered_at", _TS, required=True, default=NOW),
        ),
    ),
    "classifications": Table(
        key="id",
        columns=(
            Col("id", KEY, required=True),
            Col("site_id", KEY, required=True),
            Col("category", required=True, domain=CATEGORY),
            Col("subcategory", max_len=100),
            Col("confidence", "double", required=True),
            Col("model_version", required=True, max_len=50),
            Col("model_type", required=True, domain=MODEL_TYPE),
            Col("features"),
            Col("classified_at", _TS, required=True, default=NOW),
        ),
    ),
    "safety_checks": Table(
        key="id",
        columns=(
            Col("id", KEY, required=True),
            Col("site_id", KEY, required=True),
            Col("is_safe", "boolean", required=True),
            Col("action_taken", required=True, domain=SAFETY_ACTION),
            Col("flagged_categories", "array<string>"),
            Col("risk_factors", "array<string>"),
            Col("filter_version", max_len=50),
            Col("checked_content_hash", max_len=64),
            Col("checked_at", _TS, required=True, default=NOW),
        ),
    ),
    "crawl_jobs": Table(
        key="job_id",
        columns=(
            Col("job_id", KEY, required=True),
            Col("site_id", KEY, required=True),
            Col("url", required=True),
            Col("priority", "int", default=0),
            Col("max_depth", "int", default=1),
            Col("status", required=True, default="pending", domain=JOB_STATUS),
            Col("retry_count", "int", default=0),
            Col("max_retries", "int", default=3),
            Col("error_message"),
            Col("discovered_links", "int", default=0),
            Col("created_at", _TS, required=True, default=NOW),
            Col("scheduled_for", _TS),
            Col("started_at", _TS),
            Col("completed_at", _TS),
            Col("metadata"),
        ),
    ),
    "content_hashes": Table(
        key="id",
        unique=(("site_id", "hash_type"),),
        columns=(
            Col("id", KEY, required=True),
            Col("site_id", KEY, required=True),
            Col("hash_type", required=True, domain=HASH_TYPE),
            Col("hash_value", required=True, max_len=128),
            Col("algorithm", required=True, max_len=50),
            Col("content_size", "int"),
            Col("mime_type", max_len=100),
            Col("created_at", _TS, required=True, default=NOW),
        ),
    ),
    "system_metrics": Table(
        key="id",
        columns=(
            Col("id", KEY, required=True),
            Col("circuits_active", "int"),
            Col("circuits_total", "int"),
            Col("sites_discovered", "int"),
            Col("sites_classified", "int"),
            Col("safety_checks_performed", "int"),
            Col("requests_per_minute", "double"),
            Col("error_rate", "double"),
            Col("avg_response_time", "double"),
            Col("memory_usage_mb", "double"),
            Col("cpu_percent", "double"),
            Col("disk_usage_mb", "double"),
            # byte counters outgrow 32 bits
            Col("tor_traffic_read", "bigint"),
            Col("tor_traffic_written", "bigint"),
            Col("timestamp", _TS, required=True, default=NOW),
        ),
    ),
    "audit_logs": Table(
        key="id",
        columns=(
            Col("id", KEY, required=True),
            Col("component", required=True, max_len=100),
            Col("action", required=True, max_len=100),
            Col("status", required=True, domain=AUDIT_STATUS),
            Col("researcher_id", KEY),
            Col("user_agent", max_len=500),
            Col("ip_address", max_len=45),
            Col("details"),
            Col("error_message"),
            Col("created_at", _TS, required=True, default=NOW),
        ),
    ),
}

# --- fixed values: column names in a relational database that differ from ours ----------
SOURCE_NAMES = {
    "sites": {"id": "site_id", "onion_address": "address"},
    "crawl_jobs": {"id": "job_id"},
}

# tables whose site_id references sites; those removed together with a site
SITE_CHILDREN = ("discovery_results", "classifications", "safety_checks", "crawl_jobs", "content_hashes")
CASCADED = ("discovery_results", "classifications", "safety_checks", "crawl_jobs")


def spark_type(col: Col, key_type: str = "string") -> str:
    return key_type if col.type == KEY else col.type


def table_schema(table: str, key_type: str = "string") -> T.StructType:
    """The explicit schema of a catalog table."""
    ddl = ", ".join(f"`{c.name}` {spark_type(c, key_type)}" for c in TABLES[table].columns)
    return T.StructType.fromDDL(ddl)
