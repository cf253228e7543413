"""Exact quantiles per group without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.stage import stored

#: Rows of a table with one or two per group that are sent to every task.
FEW = 20_000


def hashed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, ``rows`` rows with one or two per group, as the side of a join that is hashed.

    Few rows go to every task, more are dealt out by their keys with the rows they meet. Left to sizes, Spark sends the
    other side instead: packed values in a file, and rows still to be expanded, look small.
    """
    return F.broadcast(df) if rows <= FEW else df.hint("shuffle_hash")


def _slot(value: Column, cuts: Column, bins: int) -> Column:
    """How many of the ascending ``cuts`` are at most the value, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(bins.bit_length() - 1, -1, -1)])

    def look(at: Column, step: Column) -> Column:
        return F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), look)


def _narrowed(counts: DataFrame, state: DataFrame, keys: list[str], bins: int, ranks: int = 0) -> DataFrame:
    """Shrink each rank's value interval to the part that holds it, parts having about equally many distinct values.

    The borders come from a mergeable rank sketch of the interval's distinct values, so how they are distributed
    does not matter: a part holds one in ``bins`` of them plus the sketch's error, a few hundredths. The new
    interval is the range of the values really present in the part, and ``_left`` how many those are. ``ranks`` says how
    many rows ``state`` may have.
    """
    by = [*keys, "quantile", "_rank"]
    inside = counts.join(hashed(state, ranks), keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    sketches = inside.groupBy(*by).agg(F.kll_sketch_agg_double(F.col("_v").cast("double")).alias("_sketch"))
    cuts = sketches.select(*by, F.array_distinct(F.kll_sketch_get_quantile_double("_sketch", shares)).alias("_cuts"))
    cut = counts.join(hashed(state.join(cuts, by), ranks), keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    parts = (
        cut.groupBy(*by, "n", "_before", _slot(F.col("_v").cast("double"), F.col("_cuts"), bins).alias("_part"))
        .agg(F.sum("_n").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_left"))
    )
    # At most ``bins`` rows per rank.
    order = Window.partitionBy(*by).orderBy("_part")
    reached = parts.withColumn("_upto", F.col("_before") + F.sum("_in").over(order))
    return (
        reached.withColumn("_before", F.col("_upto") - F.col("_in"))
        .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_upto")))
        .select(*keys, "n", "_lo", "_hi", "_left", "_before", "quantile", "_rank")
    )


def located(counts: DataFrame, state: DataFrame, keys: list[str], bins: int, most: int) -> DataFrame:
    """Narrow every rank's interval until at most ``most`` distinct values are left in it.

    A round leaves a few hundredths of them, so the rounds grow with the logarithm of the distinct values. Intervals
    that no round can shrink any more stay as they are.
    """
    left, ranks = state.agg(F.max("_left"), F.count("*")).first()
    left = left or 0
    while left > most:
        wide = state.filter(F.col("_left") > most)
        state = stored(state.filter(F.col("_left") <= most).unionByName(_narrowed(counts, wide, keys, bins, ranks)), "ranks")
        before, left = left, state.agg(F.max("_left")).first()[0] or 0
        if left >= before:
            break
    return state


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: Sequence[float],
    keys: Sequence[str],
    bins: int = 64,
    most: int = 4096,
) -> DataFrame:
    """Linear-interpolated quantiles per key: columns keys, ``quantile``, ``value``, ``n``.

    Values are first counted per distinct value, which is stored. Rank sketches and exact counts then narrow the value
    interval of every wanted rank until at most ``most`` distinct values are left in it; only those
    are ordered. The result is exact for any ``bins`` and ``most``. It carries a hint for joins with the rows of its groups.
    """
    if any(not 0.0 <= q <= 1.0 for q in quantiles):
        raise ValueError(f"quantiles must lie in [0, 1], got {tuple(quantiles)!r}")
    keys = list(keys)
    counts = stored(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_n")),
        "counts",
    )
    span = counts.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_left"), F.sum("_n").alias("n")
    )
    wanted = F.array(
        *[
            F.struct(F.lit(float(q)).alias("quantile"), edge.cast("long").alias("_rank"))
            for q in quantiles
            for edge in (
                F.floor(F.lit(float(q)) * (F.col("n") - 1)),
                F.ceil(F.lit(float(q)) * (F.col("n") - 1)),
            )
        ]
    )
    state = span.select(
        *keys, "n", "_lo", "_hi", "_left", F.lit(0).cast("long").alias("_before"), F.inline(F.array_distinct(wanted))
    )
    # Stored, as it is asked for its size and then joined.
    state = located(counts, stored(state, "ranks"), keys, bins, most)
    ranks = state.count()
    order = Window.partitionBy(*keys, "quantile", "_rank").orderBy("_v")
    hits = (
        counts.join(hashed(state, ranks), keys)
        .filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .withColumn("_end", F.col("_before") + F.sum("_n").over(order))
        .filter((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n")))
    )
    place = F.col("quantile") * (F.col("n") - 1)
    found = (
        hits.groupBy(*keys, "quantile", "n")
        .agg(
            F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.min("_rank").alias("_first")
        )
        .select(
            *keys,
            "quantile",
            (F.col("_low") + (place - F.col("_first")) * (F.col("_high") - F.col("_low"))).alias("value"),
            "n",
        )
    )
    return hashed(found, ranks)
