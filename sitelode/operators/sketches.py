"""Distinct sites by stored sketches: one per method and day, merged without reading old days again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: 2^LG_K registers a sketch: 4 KB, standard error about 1.6 %.
LG_K = 12
STANDARD_ERROR = 1.04 / 2 ** (LG_K / 2)


def daily_sketches(results: DataFrame, at: str = "discovered_at") -> DataFrame:
    """(discovery_method, day, n_results, confidence_sum, sketch): what to keep of a day's discovery results.

    The sketch stands for the set of the day's sites, null ids left out. Rows without a time fall on the null day. A day and method is one row of about
    4 KB whatever it held; sketches are built before the shuffle. Write it partitioned by `day`, a day at a time.
    """
    return results.groupBy("discovery_method", F.col(at).cast("date").alias("day")).agg(
        F.count("*").alias("n_results"),
        F.sum("confidence").alias("confidence_sum"),
        F.count("confidence").alias("n_confidence"),
        F.hll_sketch_agg("site_id", LG_K).alias("sketch"),
    )


def merged_sketches(stored: DataFrame, keys: Sequence[str] = ("discovery_method",)) -> DataFrame:
    """Stored rows folded to `keys`: the union of their sketches and the sums of their counts; can be stored and merged again."""
    return stored.groupBy(*keys).agg(
        F.sum("n_results").alias("n_results"), F.sum("confidence_sum").alias("confidence_sum"), F.sum("n_confidence").alias("n_confidence"),
        F.hll_union_agg("sketch").alias("sketch"),
    )


def discovery_by_method_estimated(stored: DataFrame, keys: Sequence[str] = ("discovery_method",)) -> DataFrame:
    """`discovery_by_method` from stored sketches: results and mean confidence exact, `n_sites` estimated (STANDARD_ERROR).

    Where the exact number is needed `metrics.discovery_by_method` reads the results themselves.
    """
    merged = merged_sketches(stored, keys)
    return merged.select(
        *keys, "n_results", F.hll_sketch_estimate("sketch").alias("n_sites"),
        F.try_divide("confidence_sum", "n_confidence").alias("mean_confidence"),
    )
