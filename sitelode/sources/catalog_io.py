"""Reading and writing the catalog tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitelode.functions.scalars import iso_text
from sitelode.schema import SOURCE_NAMES, TABLES, table_schema

COMMITTED = "_COMMITTED"


def load_table(spark: SparkSession, root: str, table: str, key_type: str = "string", fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(table_schema(table, key_type)).load(f"{root}/{table}")


def load_catalog(spark: SparkSession, root: str, key_type: str = "string", fmt: str = "parquet") -> dict[str, DataFrame]:
    """The eight tables under `root`, of the current version if it holds versions; one never written is an empty frame."""
    tables = {}
    for name in TABLES:
        folder = table_folder(spark, root, name)
        if folder is None:
            tables[name] = spark.createDataFrame([], table_schema(name, key_type))
        else:
            tables[name] = spark.read.format(fmt).schema(table_schema(name, key_type)).load(folder)
    return tables


def table_folder(spark: SparkSession, root: str, table: str) -> str | None:
    """Where a table is now: in the newest committed version that has it, or directly under a root without versions."""
    fs, _ = _filesystem(spark, root)
    versions = _versions(spark, root)
    if versions:
        places = [f"{root}/v={v}/{table}" for v in sorted(versions, reverse=True) if versions[v]]
    else:
        places = [f"{root}/{table}"]
    return next((p for p in places if fs.exists(_path(spark, p))), None)


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key_type: str = "string",
    partition_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """A catalog table from a relational database, read in parallel by a numeric or date column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )
    return from_source(reader.load(), table, key_type)


def from_source(frame: DataFrame, table: str, key_type: str = "string") -> DataFrame:
    """Rows of a relational table in our column names and types; missing columns are null."""
    named = frame.withColumnsRenamed(SOURCE_NAMES.get(table, {}))
    return named.select(
        *[
            (F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_schema(table, key_type)
        ]
    )


def to_source(frame: DataFrame, table: str) -> DataFrame:
    """Rows under the column names of the relational table; the way back of `from_source`."""
    return frame.withColumnsRenamed({ours: theirs for theirs, ours in SOURCE_NAMES.get(table, {}).items()})


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    named = to_source(df, table)
    named.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()


def append_rows(df: DataFrame, root: str, table: str) -> None:
    """Append rows to a catalog table where it is now; Spark's commit makes them visible at once."""
    spark = df.sparkSession
    version = current_version(spark, root)
    fresh = f"{root}/{table}" if version is None else f"{root}/v={version}/{table}"
    folder = table_folder(spark, root, table) or fresh
    df.select(*TABLES[table].names).write.mode("append").parquet(folder)


def layout_by_address(sites: DataFrame, partitions: int) -> DataFrame:
    """Hash the sites by address, so each address lives in one known partition."""
    return sites.repartition(partitions, "address")


#: Look-ups of at most so many addresses become a filter of the scan, above it a join.
MOST_FILTERED = 64


def write_address_layout(sites: DataFrame, path: str, files: int, rows_per_file: int = 1_000_000) -> None:
    """Write the sites sorted by address over `files` files, with bloom filters on the address.

    Every file and row group covers a range of addresses, so a look-up of a few skips nearly all by their least and greatest
    address, and by the bloom filter the one that would hold an address that is not there. `rows_per_file` sizes the
    filter. The ranges come from a sample, so files are about equal; sites without address come first.
    """
    ranged = sites.repartitionByRange(files, F.asc_nulls_first("address")).sortWithinPartitions(F.asc_nulls_first("address"))
    writer = ranged.write.option("parquet.bloom.filter.enabled#address", "true")
    writer.option("parquet.bloom.filter.expected.ndv#address", str(rows_per_file)).parquet(path)


def lookup_addresses(layout: DataFrame, keys: DataFrame) -> DataFrame:
    """The sites of an address layout whose address is in `keys` (address); exact and case-sensitive.

    Up to MOST_FILTERED different addresses are compared in the scan, which then reads only the row groups that may hold them;
    more are a join. Either way a site comes once however often its address is asked for, and a null asks for nothing.
    """
    wanted = keys.select("address").filter(F.col("address").isNotNull()).distinct()
    few = [r.address for r in wanted.limit(MOST_FILTERED + 1).collect()]
    if len(few) > MOST_FILTERED:
        return layout.join(wanted, "address", "left_semi")
    # a list of equalities, as longer IN lists are only pushed down as a range
    return layout.filter(reduce(Column.__or__, (F.col("address") == a for a in sorted(few)), F.lit(False)))


def save_bucketed(df: DataFrame, table: str, buckets: int, column: str = "address") -> None:
    """Save as a table bucketed by `column`; joins on it then need no shuffle of the table.

    Meant for sites by address, and for link tables by `src` before deep searches.
    """
    (
        df.repartition(buckets, column)
        .write.bucketBy(buckets, column)
        .sortBy(column)
        .mode("overwrite")
        .saveAsTable(table)
    )


def write_audit_layout(logs: DataFrame, path: str) -> None:
    """One directory per day, sorted by component and action for row-group pruning."""
    day = logs.withColumn("day", F.col("created_at").cast("date"))
    (
        day.repartitionByRange("day", "component", "action", "created_at")
        .sortWithinPartitions("day", "component", "action")
        .write.partitionBy("day")
        .mode("append")
        .parquet(path)
    )


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark: SparkSession, path: str):
    made = _path(spark, path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, made = _filesystem(spark, path)
    return bool(fs.getFileStatus(made).isDirectory())


def _versions(spark: SparkSession, root: str) -> dict[int, bool]:
    """Version numbers under `root` and whether each was committed."""
    fs, base = _filesystem(spark, root)
    if not fs.exists(base):
        return {}
    found = {}
    for status in fs.listStatus(base):
        name = status.getPath().getName()
        if name.startswith("v=") and name[2:].isdigit():
            found[int(name[2:])] = fs.exists(_path(spark, f"{root}/{name}/{COMMITTED}"))
    return found


def write_atomic(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> int:
    """Write all tables as one new version of the catalog; all become visible or none.

    Tables that are not given stay as the newest version that has them left them.

    The version directory is claimed by creating a file that must not exist, and
    counts only once its commit marker is there. After an error the old version
    stays current. Two writers need a file system whose create is atomic, as HDFS's is.
    """
    fs, _ = _filesystem(spark, root)
    version = max(_versions(spark, root), default=0) + 1
    while not _create_new(spark, fs, f"{root}/v={version}/_CLAIMED"):
        version += 1
    for name, frame in tables.items():
        frame.write.parquet(f"{root}/v={version}/{name}")
    _create_new(spark, fs, f"{root}/v={version}/{COMMITTED}")
    return version


def _create_new(spark: SparkSession, fs, path: str) -> bool:
    """Create an empty file; False when another writer has it already."""
    return bool(fs.createNewFile(_path(spark, path)))


def current_version(spark: SparkSession, root: str) -> int | None:
    return max((v for v, done in _versions(spark, root).items() if done), default=None)


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table as the newest committed version that has it left it."""
    if current_version(spark, root) is None:
        raise FileNotFoundError(f"no committed version under {root}")
    folder = table_folder(spark, root, table)
    if folder is None:
        raise FileNotFoundError(f"no committed version under {root} has {table}")
    return spark.read.parquet(folder)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row, times in ISO form; null fields are kept."""
    shown = [
        iso_text(name).alias(name) if kind.startswith("timestamp") else F.col(name) for name, kind in df.dtypes
    ]
    return df.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))


def export_json(df: DataFrame, path: str) -> None:
    json_lines(df).write.text(path)
