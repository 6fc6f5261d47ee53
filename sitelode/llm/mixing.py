"""Mixing sources to target weights: whole copies by repetition rate and one seeded draw for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

from pyspark.sql import Column, DataFrame, functions as F

from sitelode.functions.layout import exact_running_sum
from sitelode.session import materialize

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEED = 20
#: Bits of a draw: what a double holds exactly.
DRAW_BITS = 52


def word_count(text: Column) -> Column:
    """Words of a text, cut at ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def draw(key: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 2^DRAW_BITS) that only seed, key and text decide; null key and text count as empty."""
    parts = [F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def source_targets(
    sized: DataFrame, *, source: str = "source", size: str = "size", weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """(source, source_size, weight, target, rate): how many words each source is to give.

    Sources in code-point order, null last, take `weights` in turn and share the size of all by weight. A target
    above `most` times its source's size stops there; the excess goes to the other sources by weight, until no target is above.
    `rate` is target by size, 0 for a source without size. Sizes are added up before the shuffle, so a source of any
    share is one row; every round is one sum over the sources, and the driver holds two numbers.
    """
    if not weights or min(weights) < 1 or most < 1:
        raise ValueError("weights and most must be at least 1")
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("source_size"))
    ranked = exact_running_sum(
        totals.withColumns({"_all": F.lit(1), "_one": F.lit(1)}), ["_all"], [F.asc_nulls_last("source")], "_one", "_rank"
    )
    turn = F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int")
    weighed = materialize(
        ranked.select("source", "source_size", F.get(F.array(*[F.lit(int(w)) for w in weights]), turn).cast("bigint").alias("weight")), "sources"
    )
    unit = lcm(*[int(w) for w in weights])
    # a source is full from this share of a weight unit on
    level = weighed.withColumn("_full_at", (F.col("source_size") * most).cast("decimal(38,0)") * (F.lit(unit) / F.col("weight")).cast("decimal(10,0)"))
    total, all_weights = (int(v or 0) for v in level.agg(F.sum("source_size"), F.sum("weight")).first())
    left, weight_left, full = total, all_weights, F.lit(False)
    while weight_left:
        # exact whole numbers: full_at * weight_left <= left * unit
        now = F.col("_full_at") * F.lit(weight_left).cast("decimal(18,0)") <= F.expr(f"{left * unit}BD")
        found = level.filter(now).agg(F.sum(F.col("source_size").cast("decimal(38,0)") * most), F.sum("weight")).first()
        spent, weight_spent = (int(v or 0) for v in found)
        full = now
        if (total - spent, all_weights - weight_spent) == (left, weight_left):
            break
        left, weight_left = total - spent, all_weights - weight_spent
    share = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(max(weight_left, 1)))
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(share)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    return level.select("source", "source_size", "weight", target.alias("target")).withColumn("rate", rate)


def with_copies(sized: DataFrame, targets: DataFrame, *, source: str = "source", drawn: str = "draw") -> DataFrame:
    """Add source_size, target, rate and copies: floor(rate), and one more where the draw falls below the fraction.

    Former columns of these names are replaced. The targets have one row per source and are joined by Spark's own choice:
    broadcast when their written size allows it, else sorted, where adaptive execution splits a hot source.
    """
    rows = sized.drop("source_size", "target", "rate", "copies")
    named = targets.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    joined = rows.join(named, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor("rate")
    one_more = F.col(drawn).cast("double") / F.lit(float(1 << DRAW_BITS)) < F.col("rate") - whole
    return joined.withColumn("copies", whole.cast("bigint") + one_more.cast("bigint"))


def mix(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED,
) -> DataFrame:
    """The mixed corpus: every row of `df` as often as it is taken, with `copy` numbered from 1.

    A row is taken floor(rate) times, rate being target by size of its source (`source_targets`), and once more with a
    probability of the fraction, drawn from seed, key and text, so every run takes the same rows; rows equal in key and
    text draw alike. No row is taken more than `most` times. Null text counts as empty, a null source is a source, a null
    key is drawn by its text. Rows of a source without words are not taken. An empty table gives no rows. All
    columns are kept; one named `copy` is replaced.
    """
    rows = df.drop("copy")
    sized = rows.select(
        F.struct("*").alias("_row"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"), draw(F.col(key), F.col(text), seed).alias("draw"),
    )
    targets = materialize(source_targets(sized, weights=weights, most=most), "targets")
    taken = with_copies(sized, targets).filter(F.col("copies") > 0)
    return taken.select("_row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
