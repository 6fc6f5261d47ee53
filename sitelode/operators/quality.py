"""Validation: every check is one pass over its table and returns findings as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sitelode.functions.scalars import as_col, ts
from sitelode.schema import ADDRESS_LENGTH, ADDRESS_SUFFIX, NOW, SITE_CHILDREN, TABLES, spark_type

BAD_SUFFIX = "address must end with .onion"
BAD_LENGTH = "invalid address length"


def address_error(address: Column | str) -> Column:
    """Why an address is invalid, or null: suffix first, then total length."""
    address = as_col(address)
    return (
        F.when(~F.coalesce(address.endswith(ADDRESS_SUFFIX), F.lit(False)), BAD_SUFFIX)
        .when(F.length(address) != ADDRESS_LENGTH, BAD_LENGTH)
        .otherwise(F.lit(None).cast("string"))
    )


def address_validate(df: DataFrame, address: str = "address") -> DataFrame:
    return df.withColumn("error", address_error(address))


def range_check(df: DataFrame, column: str, key: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows out of [low, high]; a null has the wrong type, which is another finding."""
    value = F.col(column)
    problem = F.when(value.isNull(), "type").when(~value.between(low, high), "range")
    return df.select(F.col(key), value.alias("value"), problem.alias("problem")).filter("problem IS NOT NULL")


def _declared(df: DataFrame, table: str):
    return [c for c in TABLES[table].columns if c.name in df.columns]


def domain_check(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, value, n) for values outside their declared domain."""
    checks = []
    for col in _declared(df, table):
        if col.domain:
            bad = F.col(col.name).isNotNull() & ~F.col(col.name).isin(list(col.domain))
            checks.append(F.when(bad, F.struct(F.lit(col.name).alias("column_name"), F.col(col.name).alias("value"))))
    if not checks:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, value string, n bigint")
    found = df.select(F.explode(F.array_compact(F.array(*checks))).alias("f"))
    return (
        found.groupBy("f.column_name", "f.value")
        .agg(F.count("*").alias("n"))
        .select(F.lit(table).alias("table_name"), "column_name", "value", "n")
    )


def _count_per_column(df: DataFrame, table: str, conditions: Mapping[str, Column]) -> DataFrame:
    if not conditions:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, n bigint")
    counted = df.agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])
    return counted.unpivot([], list(conditions), "column_name", "n").select(
        F.lit(table).alias("table_name"), "column_name", "n"
    )


def not_null_check(df: DataFrame, table: str) -> DataFrame:
    """Nulls per required column (a column absent from `df` is not looked at)."""
    required = {c.name: F.col(c.name).isNull() for c in _declared(df, table) if c.required}
    return _count_per_column(df, table, required)


def length_check(df: DataFrame, table: str) -> DataFrame:
    """Values longer than declared, per column with a limit."""
    limited = {c.name: F.length(c.name) > c.max_len for c in _declared(df, table) if c.max_len}
    return _count_per_column(df, table, limited)


def unique_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values held by more than one row; a null in any key column never conflicts."""
    whole = df.na.drop(subset=list(columns))
    return whole.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def declared_unique_check(df: DataFrame, table: str) -> DataFrame:
    """(table_name, key_columns, n_keys): keys in conflict, per declared unique constraint.

    One pass for all keys of a table: every row gives each of its complete keys, as the texts of its values, and equal ones
    are counted together, before the shuffle where they can.
    """
    spec = TABLES[table]
    keys = [k for k in ((spec.key,), *spec.unique) if set(k) <= set(df.columns)]
    if not keys:
        raise ValueError(f"no unique column of {table} given")
    given = []
    for columns in keys:
        whole = reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))
        values = F.array(*[F.col(c).cast("string") for c in columns])
        given.append(F.when(whole, F.struct(F.lit(",".join(columns)).alias("key_columns"), values.alias("key"))))
    held = df.select(F.explode(F.array_compact(F.array(*given))).alias("k")).groupBy("k.key_columns", "k.key").agg(F.count("*").alias("n"))
    broken = held.groupBy("key_columns").agg(F.count_if(F.col("n") > 1).alias("n_keys"))
    none = df.sparkSession.createDataFrame([(",".join(k), 0) for k in keys], "key_columns string, n_keys bigint")
    every = broken.unionByName(none).groupBy("key_columns").agg(F.sum("n_keys").alias("n_keys"))
    return every.select(F.lit(table).alias("table_name"), "key_columns", "n_keys")


def orphan_check(sites: DataFrame, children: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, site_id, n) of references to sites that do not exist.

    Each child is first reduced to one row per site_id, so a site that owns a
    large part of a child table costs the join no more than any other.
    """
    refs = None
    for name in SITE_CHILDREN:
        if name in children:
            part = children[name].groupBy("site_id").agg(F.count("*").alias("n"))
            part = part.select(F.lit(name).alias("table_name"), "site_id", "n")
            refs = part if refs is None else refs.unionByName(part)
    if refs is None:
        raise ValueError("no child table given")
    return refs.join(sites.select("site_id"), "site_id", "left_anti").select("table_name", "site_id", "n")


def fill_defaults(
    df: DataFrame, table: str, as_of: datetime | str | Column, add_missing: bool = False, key_type: str | None = None
) -> DataFrame:
    """Declared defaults where a column is null; optionally add the missing columns.

    With `add_missing` the result has exactly the declared columns in order. Ids and references keep the type they have, as the
    tables they point to may have another; missing ones get `key_type`, by default the type of the table's own id.
    """
    spec = TABLES[table]
    now = ts(as_of)
    kinds = dict(df.dtypes)
    key_type = key_type or kinds.get(spec.key, "string")
    columns = []
    for col in spec.columns:
        kind = spark_type(col, kinds.get(col.name, key_type))
        if col.name in df.columns:
            value = F.col(col.name).cast(kind) if add_missing else F.col(col.name)
        elif add_missing:
            value = F.lit(None).cast(kind)
        else:
            continue
        if col.default is not None:
            value = F.coalesce(value, now if col.default is NOW else F.lit(col.default).cast(kind))
        columns.append(value.alias(col.name))
    if not add_missing:
        columns += [F.col(n) for n in df.columns if n not in spec.names]
    return df.select(*columns)
