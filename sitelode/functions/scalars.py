"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, functions as F

# --- fixed values ----------------------------------------------------------------
RISK_STEPS = ((0.25, "low"), (0.5, "medium"), (0.75, "high"))
RISK_TOP = "critical"
RISK_WEIGHTS = {"flagged": 0.4, "factor": 0.1, "honeypot": 0.3, "uncertain": 0.2}


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ts(as_of: datetime | str | Column) -> Column:
    """An `as_of` argument as a time-zone-free timestamp; literals are folded."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from `start` to `end` (truncated), free of any time zone."""
    gap = as_col(end) - as_col(start)
    day, hour, minute, second = (F.extract(F.lit(p), gap) for p in ("DAY", "HOUR", "MINUTE", "SECOND"))
    total = day.cast("decimal(20,6)") * 86400 + hour * 3600 + minute * 60 + second
    return total.cast("bigint")


def iso_text(column: Column | str) -> Column:
    """ISO-8601 text: six fraction digits when there is a fraction, none otherwise."""
    text = F.replace(as_col(column).cast("string"), F.lit(" "), F.lit("T"))
    return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)


def row_id(*columns: Column | str) -> Column:
    """A repeatable id from identifying columns; a re-run task makes the same id."""
    parts = [F.coalesce(as_col(c).cast("string"), F.lit("\0")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def typed_id(kind: str, *columns: Column | str) -> Column:
    """`row_id` in the key type of a table: the text, or its first 60 bits for 64-bit keys."""
    if kind == "string":
        return row_id(*columns)
    if kind == "bigint":
        return F.conv(F.substring(row_id(*columns), 1, 15), 16, 10).cast("bigint")
    raise ValueError(f"no ids of type {kind} can be made; give them")


def title_hash(title: Column | str) -> Column:
    return F.sha2(as_col(title), 256)


def content_hash(content: Column | str) -> Column:
    return F.sha2(as_col(content), 256)


def status_normalize(status: Column | str) -> Column:
    """Map `unknown`, which only one of the two status vocabularies has, to `discovered`."""
    status = as_col(status)
    return F.when(status == "unknown", F.lit("discovered")).otherwise(status)


def risk_bucket(score: Column | str) -> Column:
    score = as_col(score)
    chain = F.when(score.isNull(), F.lit(None).cast("string"))
    for bound, level in RISK_STEPS:
        chain = chain.when(score < bound, level)
    return chain.otherwise(RISK_TOP)


def risk_score(flagged: Column, factors: Column, honeypot: Column, confidence: Column) -> Column:
    """Weighted risk in [0, 1]; null inputs count as absent, null confidence as 0."""
    flagged_any = F.coalesce(F.size(flagged), F.lit(0)) > 0
    n_factors = F.greatest(F.coalesce(F.size(factors), F.lit(0)), F.lit(0))
    total = (
        F.when(flagged_any, F.lit(RISK_WEIGHTS["flagged"])).otherwise(0.0)
        + n_factors * F.lit(RISK_WEIGHTS["factor"])
        + F.when(F.coalesce(honeypot, F.lit(False)), F.lit(RISK_WEIGHTS["honeypot"])).otherwise(0.0)
        + (1 - F.coalesce(confidence, F.lit(0.0))) * F.lit(RISK_WEIGHTS["uncertain"])
    )
    return F.least(F.lit(1.0), total)


def json_feature(column: Column | str, path: str) -> Column:
    """Text value at a JSON path such as `$.k`; null where absent or not JSON."""
    return F.get_json_object(as_col(column), path)


def json_variant(column: Column | str) -> Column:
    """A JSON text as a variant, parsed once for any number of values; null where it is no JSON."""
    return F.try_parse_json(as_col(column))


def variant_value(value: Column | str, path: str, kind: str) -> Column:
    """The value at a path such as `$.a.b[0]` in a Spark type; null where it is absent or cannot be one.

    Numbers, booleans and texts convert as casts do; arrays and objects as `array<...>`, `struct<...>` or `variant`.
    """
    return F.try_variant_get(as_col(value), path, kind)


def has_any_tag(tags: Column | str, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(as_col(tags), F.array(*[F.lit(t) for t in wanted]))


def has_all_tags(tags: Column | str, wanted: Sequence[str]) -> Column:
    unique = sorted(set(wanted))
    return F.size(F.array_intersect(as_col(tags), F.array(*[F.lit(t) for t in unique]))) == len(unique)


def words(text: Column | str, pattern: str = "[a-z]+") -> Column:
    """Lower-case words of a text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(as_col(text)), F.lit(pattern), F.lit(0))


def one_of(column: Column, values: Sequence[str]) -> Column:
    return column.isin(list(values))
