"""Confidences on one scale: isotonic calibration from labelled rows, and its error."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

BINS = 20


def bin_of(confidence: Column, bins: int = BINS) -> Column:
    """Bin 0..bins-1 of a confidence in [0, 1]; 1 belongs to the last. Null stays null."""
    inside = F.least(F.greatest(F.floor(confidence * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return F.when(confidence.isNotNull(), inside)


def reliability(judged: DataFrame, hit: Column, confidence: str = "confidence", bins: int = BINS) -> DataFrame:
    """(bin, n, hits, mean): rows, right verdicts and mean confidence per bin; at most `bins` rows, summed before the shuffle."""
    value = F.col(confidence)
    counted = judged.filter(value.isNotNull() & hit.isNotNull()).groupBy(bin_of(value, bins).alias("bin"))
    return counted.agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.avg(value).alias("mean"))


def isotonic(counts: Iterable[tuple[int, int, int]], bins: int = BINS) -> list[float | None]:
    """Share of hits per bin from (bin, n, hits), made non-decreasing by pooling neighbours that fall.

    Least squares under that order, in exact fractions. A bin without rows takes the value of the filled bin below
    it, the lowest ones that of the first filled one; without any rows all are None.
    """
    pools: list[list] = []  # hits, rows, bins
    for place, n, hits in sorted(counts):
        if n:
            pools.append([hits, n, [place]])
        while len(pools) > 1 and Fraction(pools[-2][0], pools[-2][1]) >= Fraction(pools[-1][0], pools[-1][1]):
            hits, n, places = pools.pop()
            pools[-1] = [pools[-1][0] + hits, pools[-1][1] + n, pools[-1][2] + places]
    known = {place: hits / n for hits, n, places in pools for place in places}
    if not known:
        return [None] * bins
    value, out = known[min(known)], []
    for place in range(bins):
        value = known.get(place, value)
        out.append(value)
    return out


def fit_calibration(judged: DataFrame, hit: Column, confidence: str = "confidence", bins: int = BINS) -> list[float | None]:
    """The calibration table of a classifier from rows whose truth is known: `bins` rows reach the driver."""
    rows = reliability(judged, hit, confidence, bins).collect()
    return isotonic([(r["bin"], r["n"], r["hits"]) for r in rows], bins)


def calibrated(confidence: Column, table: Sequence[float | None]) -> Column:
    """The share of right verdicts among rows as confident as this one; null where nothing is known."""
    listed = F.from_json(F.lit(json.dumps(list(table))), "array<double>")
    return F.get(listed, bin_of(confidence, len(table)))


def calibration_error(counts: DataFrame) -> DataFrame:
    """(n, error): mean distance of confidence and share of hits over the bins of `reliability`, weighted by rows."""
    gap = F.abs(F.col("mean") - F.col("hits") / F.col("n")) * F.col("n")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(gap) / F.sum("n")).alias("error"))
