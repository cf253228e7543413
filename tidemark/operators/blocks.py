"""Ordered computation over long series without one task per series.

A series is cut into blocks of consecutive positions. Windows run inside ``(keys, block)``,
so a single series that holds a third of all rows is still spread over many tasks. What
crosses a block edge is handled in one of two exact ways:

* ``with_margin``: bounded look-back/look-ahead on a regular grid; the few rows next to an
  edge are copied into the neighbouring block and flagged, then dropped after the window;
* block summaries: one row per ``(keys, block)`` (first row, last row, counts). A window
  over the summaries is short - rows divided by the block size - and its result is merged
  back. Both readers of the rows ask for the same columns, so Spark reuses the exchange.

Blocks of grid rows are equal stretches of positions. Raw stamps may crowd, so their blocks are
cut by counts (``equal_blocks``). Exchanges state no number of partitions, so that adaptive
execution may join small ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeline import floor_div
from tidemark.plans.stage import stored

BLOCK = "_block"
CORE = "_core"
DEFAULT_BLOCK_STEPS = 4096
KEYS = ("series_key",)

Merge = tuple[Column, Callable[[str], Column]]


def position_block(position: Column, block_steps: int = DEFAULT_BLOCK_STEPS) -> Column:
    """Block number of an integer position."""
    return floor_div(position, block_steps)


def time_block(ts: Column, width_us: int) -> Column:
    """Block number of a timestamp for blocks of a fixed time width."""
    return floor_div(F.unix_micros(ts.cast("timestamp")), width_us)


#: Rows a block of equal depth holds at most, and how many crowded slots may be cut again.
BLOCK_ROWS = 100_000
CROWDED = 100_000


def finer(width: int) -> int:
    """The next width: the largest divisor that cuts a slot into 32 or more, else single units."""
    return next((width // f for f in range(32, 129) if width % f == 0), 1)


def equal_blocks(
    df: DataFrame, keys: Sequence[str], time: str, width_us: int, most: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``_block``: time slots of at most ``most`` rows of one series, in the order of time.

    Rows are counted per slot of ``width_us``. Slots that hold more are cut again, into slots a fraction as
    wide, until none holds more or the slots are single microseconds, so a series that crowds its rows into
    one day is spread like any other. A block is named by its first microsecond. Only crowded
    slots are told to the tasks; above ``CROWDED`` of them ``most`` grows, so that their table stays bounded.
    Counting is a job of its own and reads ``df``.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    slot = lambda width: floor_div(at, width) * F.lit(width)
    out = df.withColumn(BLOCK, slot(width_us))
    open_rows, width = df, width_us
    while True:
        counts = open_rows.filter(at.isNotNull()).groupBy(*keys, slot(width).alias(BLOCK)).agg(F.count("*").alias("_n"))
        fullest, total = counts.agg(F.max("_n"), F.sum("_n")).first()
        most = max(most, -(-(total or 0) // CROWDED))
        if width == 1 or (fullest or 0) <= most:
            return out
        crowded = counts.filter(F.col("_n") > most).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(BLOCK).alias("_slot"))
        crowded = F.broadcast(stored(crowded, "crowded"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        named = [f"_k{i}" for i in range(len(keys))]
        open_rows = open_rows.join(crowded, [*same, slot(width) == F.col("_slot")], "left_semi")
        narrow = finer(width)
        # A slot of this width is a block's name only where no wider one was left whole.
        out = out.join(crowded, [*same, F.col(BLOCK) == F.col("_slot"), slot(width) == F.col("_slot")], "left")
        out = out.withColumn(BLOCK, F.when(F.col("_slot").isNotNull(), slot(narrow)).otherwise(F.col(BLOCK))).drop(*named, "_slot")
        width = narrow


def spread_steps(
    bounds: DataFrame,
    keys: Sequence[str],
    first: str,
    last: str,
    out: str,
    block_steps: int = DEFAULT_BLOCK_STEPS,
) -> DataFrame:
    """One row per integer in ``[first, last]`` of each bounds row.

    Expanded in two stages with a repartition between them, so one long series is written
    by many tasks and no array is longer than a block.
    """
    low = floor_div(F.col(first), block_steps)
    high = floor_div(F.col(last), block_steps)
    blocks = bounds.withColumn(BLOCK, F.explode(F.sequence(low, high)))
    spread = blocks.repartition(*keys, BLOCK)
    begin = F.greatest(F.col(first), F.col(BLOCK) * F.lit(block_steps))
    end = F.least(F.col(last), F.col(BLOCK) * F.lit(block_steps) + F.lit(block_steps - 1))
    return spread.withColumn(out, F.explode(F.sequence(begin, end))).drop(BLOCK)


def with_margin(
    df: DataFrame,
    position: str,
    before: int,
    after: int,
    block_steps: int = DEFAULT_BLOCK_STEPS,
) -> DataFrame:
    """Add ``_block``/``_core`` and copy edge rows into the neighbouring block.

    Inside ``(keys, _block)`` a row flagged ``_core`` then sees its ``before`` previous and
    ``after`` following grid rows. Needs one row per position.
    """
    if max(before, after) > block_steps:
        raise ValueError(f"margin {before}/{after} must not exceed block_steps={block_steps}")
    block = floor_div(F.col(position), block_steps)
    if before == after == 0:
        return df.withColumn(BLOCK, block).withColumn(CORE, F.lit(True))
    offset = F.pmod(F.col(position), F.lit(block_steps))
    one = F.lit(1).cast("long")
    none = F.lit(0).cast("long")
    lowest = block - F.when(offset < F.lit(after), one).otherwise(none)
    highest = block + F.when(offset >= F.lit(block_steps - before), one).otherwise(none)
    copied = df.withColumn(BLOCK, F.explode(F.sequence(lowest, highest)))
    return copied.withColumn(CORE, F.col(BLOCK) == block)


def drop_margin(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORE)).drop(BLOCK, CORE)


def block_window(keys: Sequence[str], *order: str | Column):
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def _across(keys: Sequence[str]):
    """Window over the block summaries of one series."""
    return Window.partitionBy(*keys).orderBy(BLOCK)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    block: Column | None = None,
) -> DataFrame:
    """Exact ``lag(value, 1)`` per series over rows with arbitrary gaps.

    Rows that have a predecessor inside their block are finished locally; the first row of
    each block takes it from the summary of the last non-empty block before. Without ``block``
    the rows carry the ``_block`` of ``equal_blocks``.
    """
    columns = [c for c in df.columns if c != BLOCK]
    rows = df if block is None else df.withColumn(BLOCK, block)
    rows = rows.withColumn("_value", F.struct(value.alias("v")))
    # An explicit exchange: both branches below read the same one.
    rows = rows.repartition(*keys, BLOCK)
    window = block_window(keys, *order)
    local = rows.withColumn(out, F.lag("_value").over(window)).filter(F.col(out).isNotNull())
    moment = F.struct(*order)
    whole = F.struct(*columns)
    summary = rows.groupBy(*keys, BLOCK).agg(
        F.min_by(whole, moment).alias("_first"), F.max_by(F.col("_value"), moment).alias("_last")
    )
    edges = summary.withColumn(out, F.lag("_last").over(_across(keys)))
    # Keys come from the grouping, so that a filter on them reaches both branches alike.
    own = [F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in columns]
    first_rows = edges.select(*own, F.col(f"{out}.v").alias(out))
    return local.select(*columns, F.col(f"{out}.v").alias(out)).unionByName(first_rows)


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    flag: Column,
    block: Column,
    extra: dict[str, Merge] | None = None,
    rest: bool = False,
) -> DataFrame:
    """Maximal runs of consecutive rows with ``flag`` true, one output row per run.

    Output: keys, ``run_start``, ``run_end`` (values of ``order``), ``run_length`` and the
    ``extra`` aggregates, each given as ``(row aggregate, merge function over the partial
    column)``. Row aggregates may read ``_again``, which marks a row with the same
    ``order`` as the one before it in its block.

    With ``rest`` a series has one more row, with ``flagged`` false, for all its rows outside runs: their
    first and last ``order``, their count, and the same aggregates. So what is asked of all
    rows comes from the exchange that finds the runs.

    Runs are first built inside each block. Those that touch no block edge are final. The at
    most two edge runs of a block are kept in one row per block, chained over consecutive
    non-empty blocks and merged. Both parts read the same exchange; nothing is joined.
    """
    extra = extra or {}
    rows = df.withColumn(BLOCK, block).withColumn("_flag", F.coalesce(flag, F.lit(False)))
    rows = rows.repartition(*keys, BLOCK)
    window = block_window(keys, order)
    marked = rows.withColumns(
        {
            "_before": F.lag("_flag").over(window),
            "_after": F.lead("_flag").over(window),
            "_again": F.coalesce(F.lag(order).over(window) == F.col(order), F.lit(False)),
        }
    )
    start = F.col("_flag") & ~F.coalesce("_before", F.lit(False))
    local = marked.withColumn(
        "_run", F.sum(start.cast("long")).over(window.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_run", F.when(F.col("_flag"), F.col("_run")).otherwise(F.lit(0)))
    # Run 0 collects the unflagged rows, so that every non-empty block has a row.
    pieces = local.groupBy(*keys, BLOCK, "_run").agg(
        F.min(order).alias("run_start"),
        F.max(order).alias("run_end"),
        F.count("*").alias("run_length"),
        F.bool_or(F.col("_before").isNull()).alias("_at_head"),
        F.bool_or(F.col("_after").isNull()).alias("_at_tail"),
        *[aggregate.alias(name) for name, (aggregate, _) in extra.items()],
    )
    names = ["run_start", "run_end", "run_length", *extra]
    flagged = F.col("_run") > 0
    shown = [F.lit(True).alias("flagged")] if rest else []
    inner = pieces.filter(flagged & ~F.col("_at_head") & ~F.col("_at_tail")).select(*keys, *names, *shown)
    # At most one piece of a block touches its head and one its tail.
    piece = F.struct("_run", *names)
    edges = pieces.groupBy(*keys, BLOCK).agg(
        F.max_by(piece, F.when(flagged & F.col("_at_head"), F.lit(1))).alias("_head"),
        F.max_by(piece, F.when(flagged & F.col("_at_tail"), F.lit(1))).alias("_tail"),
        F.max_by(piece, F.when(~flagged, F.lit(1))).alias("_rest"),
    )
    series = _across(keys)
    head, tail = F.col("_head").isNotNull(), F.col("_tail").isNotNull()
    own_tail = tail & ~F.coalesce(F.col("_head._run") == F.col("_tail._run"), F.lit(False))
    opens = (head & ~F.coalesce(F.lag(tail).over(series), F.lit(False))).cast("long")
    chained = (
        edges.withColumn("_own_tail", own_tail.cast("long"))
        .withColumn("_opens", opens + F.col("_own_tail"))
        .withColumn(
            "_chain", F.sum("_opens").over(series.rowsBetween(Window.unboundedPreceding, 0))
        )
    )
    parts = F.array(
        F.struct((F.col("_chain") - F.col("_own_tail")).alias("_chain"), F.col("_head").alias("_p")),
        F.struct("_chain", F.when(F.col("_own_tail") == 1, F.col("_tail")).alias("_p")),
        # All rows outside runs are one chain.
        *([F.struct(F.lit(-1).cast("long").alias("_chain"), F.col("_rest").alias("_p"))] if rest else []),
    )
    merge = {"run_start": F.min, "run_end": F.max, "run_length": F.sum}
    merge.update({name: function for name, (_, function) in extra.items()})
    outer = (
        chained.select(*keys, F.inline(parts))
        .filter(F.col("_p").isNotNull())
        .select(*keys, "_chain", "_p.*")
        .groupBy(*keys, "_chain")
        .agg(*[merge[name](name).alias(name) for name in names])
        .select(*keys, *names, *([(F.col("_chain") >= 0).alias("flagged")] if rest else []))
    )
    return inner.unionByName(outer)
