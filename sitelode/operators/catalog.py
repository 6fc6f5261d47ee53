"""The site catalog: look-ups, searches, batch upsert, navigation and deletion."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from sitelode.functions.scalars import ts, typed_id
from sitelode.schema import CASCADED, NOW, TABLES


def site_by_id(sites: DataFrame, keys: DataFrame) -> DataFrame:
    """The site of every requested `site_id`; null columns where there is none."""
    return keys.join(sites, "site_id", "left")


def site_by_address(sites: DataFrame, keys: DataFrame) -> DataFrame:
    """Exact, case-sensitive look-up by address."""
    return keys.join(sites, "address", "left")


def pending_sites(sites: DataFrame, as_of: datetime | str, limit: int = 100, recheck_hours: int = 24) -> DataFrame:
    """Sites due for a visit, longest unchecked first.

    A null flag excludes the site, and a check exactly `recheck_hours` ago is not due yet.
    """
    cutoff = ts(as_of) - F.expr(f"INTERVAL {int(recheck_hours)} HOURS")
    due = F.col("last_checked").isNull() | (F.col("last_checked") < cutoff)
    return (
        sites.filter(due)
        .filter(F.col("status").isin("discovered", "active"))
        .filter(~F.col("is_honeypot"))
        .filter(~F.col("is_illegal"))
        .orderBy(F.asc_nulls_first("last_checked"), F.asc("site_id"))
        .limit(limit)
    )


def _escaped(query: str) -> str:
    return query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search_sites(
    sites: DataFrame,
    query: str | None = None,
    category: str | None = None,
    status: str | None = None,
    language: str | None = None,
    limit: int = 100,
    offset: int = 0,
    escape: bool = False,
) -> DataFrame:
    """Case-insensitive substring search with equality filters, last checked first.

    Empty arguments add no filter. `%` and `_` in the query are wildcards unless
    `escape` is set.
    """
    found = sites
    if query:
        like = f"%{_escaped(query) if escape else query}%"
        found = found.filter(
            F.col("title").ilike(like) | F.col("description").ilike(like) | F.col("address").ilike(like)
        )
    for column, wanted in (("category", category), ("status", status), ("language", language)):
        if wanted:
            found = found.filter(F.col(column) == wanted)
    ordered = found.orderBy(F.desc_nulls_first("last_checked"), F.asc("site_id"))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def unclassified_sites(sites: DataFrame) -> DataFrame:
    return sites.filter(F.col("category").isNull())


def honeypot_flag(sites: DataFrame, known: DataFrame) -> DataFrame:
    """Add `known_honeypot`: the address is on the list."""
    listed = known.select("address").distinct().withColumn("_listed", F.lit(True))
    return (
        sites.join(listed, "address", "left")
        .withColumn("known_honeypot", F.col("_listed").isNotNull())
        .drop("_listed")
    )


def new_addresses(found: DataFrame, sites: DataFrame) -> DataFrame:
    """Distinct found addresses the catalog does not hold yet."""
    return found.select("address").distinct().join(sites.select("address"), "address", "left_anti")


def fresh_id(address: Column, kind: str) -> Column:
    """A repeatable id for a new site: the hash of its address, or its first 60 bits for 64-bit ids."""
    return typed_id(kind, address)


def rejected_updates(updates: DataFrame) -> DataFrame:
    """Updates that name no site, with the reason."""
    return updates.filter(F.col("address").isNull()).withColumn("problem", F.lit("no address"))


def site_upsert(
    sites: DataFrame, updates: DataFrame, as_of: datetime | str, seq: str = "seq", new_id: Column | None = None
) -> DataFrame:
    """Apply a batch of updates in `seq` order; equal to applying them one by one.

    The last non-null value of a column wins (false, 0 and '' are values). An
    update of a site that exists stamps `last_checked`; a site seen for the first
    time is inserted with defaults, and only a second row for it counts as update.
    Its id comes from its address (a text, or 60 bits of it for 64-bit ids) unless
    `new_id` is given. Updates without address name no site; see `rejected_updates`.
    """
    updates = updates.filter(F.col("address").isNotNull())
    unknown = [c for c in updates.columns if c not in (seq, "address") and c not in sites.columns]
    if unknown:
        raise ValueError(f"unknown site columns: {unknown}")
    given = [c for c in updates.columns if c not in (seq, "address")]
    folded = updates.groupBy("address").agg(
        F.count("*").alias("_rows"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in given],
    )
    old, new = sites.alias("s"), folded.alias("u")
    joined = old.join(new, F.col("s.address") == F.col("u.address"), "full_outer")
    in_sites, in_batch = F.col("s.address").isNotNull(), F.col("u.address").isNotNull()
    now = ts(as_of)
    address = F.coalesce("s.address", "u.address")
    supplied = F.col("u.last_checked") if "last_checked" in given else F.lit(None).cast("timestamp_ntz")

    columns = []
    for name in sites.columns:
        old_value = F.col(f"s.{name}")
        if name == "address":
            value = address
        elif name == "site_id":
            fresh = new_id if new_id is not None else fresh_id(address, dict(sites.dtypes)[name])
            value = F.when(in_sites, old_value).otherwise(fresh.cast(dict(sites.dtypes)[name]))
            value = F.coalesce("u.site_id", value) if name in given else value
        elif name == "last_checked":
            stamped = in_sites | (F.col("_rows") > 1)
            value = F.when(~in_batch, old_value).when(stamped, now).otherwise(supplied)
        else:
            value = F.coalesce(F.col(f"u.{name}"), old_value) if name in given else old_value
            default = TABLES["sites"].column(name).default if name in TABLES["sites"].names else None
            if default is not None:  # for inserted rows only: an old null stays null
                filler = now if default is NOW else F.lit(default)
                value = F.when(in_sites, value).otherwise(F.coalesce(value, filler))
        columns.append(value.alias(name))
    return joined.select(*columns)


def with_site_values(sites: DataFrame, values: DataFrame) -> DataFrame:
    """Write back what a run found: (site_id, columns ...), one row per site; a null leaves the site's value.

    A declared column that `sites` lacks is added with its default.
    """
    found = [c for c in values.columns if c != "site_id"]
    joined = sites.join(values.withColumnsRenamed({c: f"_new_{c}" for c in found}), "site_id", "left")
    columns = [F.coalesce(f"_new_{c}", c).alias(c) if c in found else F.col(c) for c in sites.columns]
    for name in found:
        if name not in sites.columns:
            default = TABLES["sites"].column(name).default
            columns.append(F.coalesce(f"_new_{name}", F.lit(default)).alias(name) if default is not None else F.col(f"_new_{name}").alias(name))
    return joined.select(*columns)


def children_with_site(child: DataFrame, sites: DataFrame, columns: tuple[str, ...] = ("address", "status")) -> DataFrame:
    """Each child row with columns of the site it belongs to, prefixed `site_`."""
    parent = sites.select("site_id", *[F.col(c).alias(f"site_{c}") for c in columns])
    return child.join(parent, "site_id")


def site_children(
    sites: DataFrame, discovery_results: DataFrame, classifications: DataFrame, safety_checks: DataFrame, crawl_jobs: DataFrame
) -> DataFrame:
    """Per site the number of rows and the newest time in each child table.

    The children are stacked and aggregated once, in place of four joins whose
    rows would multiply; the rows themselves come from `children_with_site`.
    """
    times = {
        "discoveries": (discovery_results, "discovered_at"),
        "classifications": (classifications, "classified_at"),
        "checks": (safety_checks, "checked_at"),
        "jobs": (crawl_jobs, "created_at"),
    }
    stacked = None
    for kind, (frame, time) in times.items():
        part = frame.select("site_id", F.lit(kind).alias("kind"), F.col(time).alias("at"))
        stacked = part if stacked is None else stacked.unionByName(part)
    per_kind = []
    for kind in times:
        per_kind.append(F.count_if(F.col("kind") == kind).alias(f"n_{kind}"))
        per_kind.append(F.max(F.when(F.col("kind") == kind, F.col("at"))).alias(f"last_{kind}"))
    counts = stacked.groupBy("site_id").agg(*per_kind)
    return (
        sites.select("site_id", "address")
        .join(counts, "site_id", "left")
        .fillna(0, subset=[f"n_{k}" for k in times])
    )


def cascade_delete(tables: Mapping[str, DataFrame], keys: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete sites with their children; a site that still owns content hashes stays.

    Returns the remaining tables and the refused keys.
    """
    wanted = keys.select("site_id").distinct()
    owners = tables["content_hashes"].select("site_id").distinct()
    refused = wanted.join(owners, "site_id", "left_semi")
    deleted = wanted.join(owners, "site_id", "left_anti")
    remaining = {
        name: frame.join(deleted, "site_id", "left_anti") if name in CASCADED or name == "sites" else frame
        for name, frame in tables.items()
    }
    return remaining, refused
