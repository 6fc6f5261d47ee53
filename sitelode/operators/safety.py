"""Content safety: pattern flags, size gate and the resulting action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitelode.functions.literals import any_of, found_by, required_literals
from sitelode.functions.scalars import as_col
from sitelode.sources.text_lists import Pattern

MAX_CONTENT_BYTES = 10 * 1024 * 1024


def over_size(content: Column | str, max_bytes: int = MAX_CONTENT_BYTES) -> Column:
    """Content larger than `max_bytes`; bytes, not characters."""
    return F.octet_length(as_col(content)) > max_bytes


def size_gate(documents: DataFrame, content: str = "text", max_bytes: int = MAX_CONTENT_BYTES) -> DataFrame:
    return documents.withColumn("over_size", over_size(content, max_bytes))


def _java_regex(pattern: Pattern) -> str:
    return f"(?{pattern.flags}){pattern.regex}"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sum(columns: Sequence[Column]) -> Column:
    """A sum as a balanced tree, as a chain over thousands of columns is too deep to plan."""
    if len(columns) < 2:
        return columns[0] if columns else F.lit(0)
    middle = len(columns) // 2
    return _sum(columns[:middle]) + _sum(columns[middle:])


def pattern_flag(documents: DataFrame, patterns: Sequence[Pattern], content: str = "text") -> DataFrame:
    """Add `flagged_categories` (in pattern-file order) and `n_matches`.

    A pattern that cannot match without some literal text (`required_literals`) is tried only on content that holds it; one
    pass over the content finds the literals of all patterns, so many patterns cost little more than a few. The others
    scan every content. Contents are read whole whatever their size; the size gate is a column of its own. Null content has no flags.
    """
    needed = [required_literals(p.regex, p.flags) for p in patterns]
    literals = sorted({text for texts in needed for text in texts or ()})
    says = found_by(literals)
    scanned = documents.withColumn("_scanned", F.coalesce(F.col(content), F.lit("")))
    if literals:
        folded = F.translate("_scanned", UPPER, LOWER)
        scanned = scanned.withColumn("_found", F.array_distinct(F.regexp_extract_all(folded, F.lit(f"(?=({any_of(literals)}))"), F.lit(1))))
    counts = {}
    for i, (pattern, texts) in enumerate(zip(patterns, needed)):
        count = F.regexp_count(F.col("_scanned"), F.lit(_java_regex(pattern)))
        if texts:
            signs = F.array(*[F.lit(s) for s in sorted({s for t in texts for s in says[t]})])
            count = F.when((F.size("_found") > 0) & F.arrays_overlap(F.col("_found"), signs), count).otherwise(F.lit(0))
        counts[f"_hits{i}"] = count
    scanned = scanned.withColumns(counts) if counts else scanned
    by_category: dict[tuple[int, str], list[str]] = {}
    for name, pattern in zip(counts, patterns):
        by_category.setdefault((pattern.category_no, pattern.category), []).append(name)
    flags = [
        F.when(F.greatest(F.lit(0), *names) > 0, F.lit(category)) for (_, category), names in sorted(by_category.items())
    ]
    flagged = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    return scanned.withColumns(
        {"flagged_categories": flagged, "n_matches": _sum([F.col(name) for name in counts])}
    ).drop("_scanned", "_found", *counts)


def safety_check(
    df: DataFrame,
    flagged: str = "flagged_categories",
    too_big: str = "over_size",
    honeypot: str = "is_honeypot",
    factors: str = "risk_factors",
) -> DataFrame:
    """Add `action_taken` and `is_safe`.

    Any flagged category blocks; else oversize content is quarantined; else a
    honeypot or any risk factor asks for review; else the content is allowed.
    Null inputs count as absent.
    """
    def present(column: Column) -> Column:
        return F.coalesce(column, F.lit(False))

    action = (
        F.when(present(F.size(flagged) > 0), "block")
        .when(present(F.col(too_big)), "quarantine")
        .when(present(F.col(honeypot)) | present(F.size(factors) > 0), "review")
        .otherwise("allow")
    )
    return df.withColumn("action_taken", action).withColumn("is_safe", F.col("action_taken") == "allow")
