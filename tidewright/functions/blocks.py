"""Windows that never gather a whole series into one task.

A plain ``Window.partitionBy(station)`` sends every row of a station to one task, so one hot station
decides how long the job runs. The helpers here cut each series into fixed blocks of its integer index
(hours, positions or bins) and shuffle by ``(keys, block)``:

* bounded frames look a known distance back and ahead, so each block also receives copies of the few
  rows just outside it (its halo);
* unbounded running results are two-level: inside the block first, then over one summary row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_HOURS = 672  # four weeks of hourly rows


def hour_number(ts: str | Column) -> Column:
    """Whole hours since the epoch (UTC session)."""
    return F.floor(F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts) / 3600)


def hour_timestamp(hour: str | Column) -> Column:
    """Inverse of :func:`hour_number`."""
    return F.timestamp_seconds((F.col(hour) if isinstance(hour, str) else hour) * 3600)


def halo_window(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    columns: dict[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    block: int = BLOCK_HOURS,
    first: dict[str, Callable[[WindowSpec], Column]] | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` back and ``after`` ahead of ``index``.

    ``first`` are window columns of a block and its halo that ``columns`` may use, such as running sums.

    ``index`` is an integer column, unique per key; rows without one are left out. Frames must be
    ``rangeBetween`` frames, so a missing hour is simply absent from the frame.
    """
    position = F.col(index)
    spread = df.withColumn(
        "_block",
        F.explode(F.sequence(F.floor((position - after) / block), F.floor((position + before) / block))),
    )
    window = Window.partitionBy(*keys, "_block").orderBy(index)
    return (
        spread.withColumns({name: make(window) for name, make in (first or {}).items()})
        .withColumns({name: make(window) for name, make in columns.items()})
        .where(F.col("_block") == F.floor(position / block))
        .drop("_block")
    )


def at_offset(value: str | Column, offset: int) -> Callable[[WindowSpec], Column]:
    """Value exactly ``offset`` index steps away, null when that step is missing."""
    return lambda w: F.max(value).over(w.rangeBetween(offset, offset))


def global_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], block: Column, name: str = "position"
) -> DataFrame:
    """1-based row number per key without one task per key.

    ``block`` must not decrease along ``order``. Rows are numbered inside their block, then shifted by
    the number of rows in earlier blocks (one summary row per block).
    """
    tagged = df.withColumn("_piece", block)
    inner = Window.partitionBy(*keys, "_piece").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_piece")
        .agg(F.count("*").alias("_piece_rows"))
        .select(*keys, "_piece", F.coalesce(F.sum("_piece_rows").over(earlier), F.lit(0)).alias("_piece_offset"))
    )
    return (
        tagged.withColumn("_piece_row", F.row_number().over(inner))
        .join(offsets, [*keys, "_piece"])
        .withColumn(name, F.col("_piece_row") + F.col("_piece_offset"))
        .drop("_piece", "_piece_row", "_piece_offset")
    )


def sessions(
    df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, block_seconds: int = 86400
) -> DataFrame:
    """Number runs of distinct times per key; a gap longer than ``gap_seconds`` starts a new run.

    Returns ``keys, ts, segment``. Gaps are measured inside day blocks, and the first row of a block is
    judged against the last row of the block before it.
    """
    times = (
        df.where(F.col(ts).isNotNull())
        .select(*keys, ts)
        .distinct()
        .withColumn("_block", F.floor(F.unix_seconds(ts) / block_seconds))
    )
    inner = Window.partitionBy(*keys, "_block").orderBy(ts)
    seconds = F.unix_micros(ts) / 1e6
    marked = times.withColumn("_start", (seconds - F.lag(seconds).over(inner) > gap_seconds).cast("int"))
    blocks = Window.partitionBy(*keys).orderBy("_block")
    summary = (
        marked.groupBy(*keys, "_block")
        .agg(
            F.min(seconds).alias("_first"),
            F.max(seconds).alias("_last"),
            F.coalesce(F.sum("_start"), F.lit(0)).alias("_inside"),
        )
        .withColumn("_previous", F.lag("_last").over(blocks))
        .withColumn(
            "_opens", F.coalesce((F.col("_first") - F.col("_previous") > gap_seconds).cast("int"), F.lit(1))
        )
        .withColumn(
            "_base",
            F.sum(F.col("_opens") + F.col("_inside")).over(blocks.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("_inside"),
        )
        .select(*keys, "_block", "_base")
    )
    running = inner.rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("_run", F.coalesce(F.sum("_start").over(running), F.lit(0)))
        .join(summary, [*keys, "_block"])
        .select(*keys, ts, (F.col("_base") + F.col("_run")).alias("segment"))
    )


def nearest_known(
    df: DataFrame, keys: Sequence[str], index: str, value: str, block: int = BLOCK_HOURS
) -> DataFrame:
    """Add the closest known ``value`` at or before and at or after each row, with its index.

    New columns: ``prev_index, prev_value, next_index, next_value``. Blocks without any known value are
    bridged through the per-block summary.
    """
    tagged = df.withColumn("_block", F.floor(F.col(index) / block))
    inner = Window.partitionBy(*keys, "_block").orderBy(index)
    back = inner.rowsBetween(Window.unboundedPreceding, 0)
    ahead = inner.rowsBetween(0, Window.unboundedFollowing)
    anchor = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    blocks = Window.partitionBy(*keys).orderBy("_block")
    edge = (
        tagged.groupBy(*keys, "_block")
        .agg(F.min(anchor).alias("_first"), F.max(anchor).alias("_last"))
        .select(
            *keys,
            "_block",
            F.last("_last", True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_back"),
            F.first("_first", True).over(blocks.rowsBetween(1, Window.unboundedFollowing)).alias("_carry_ahead"),
        )
    )
    return (
        tagged.withColumn("_back", F.last(anchor, True).over(back))
        .withColumn("_ahead", F.first(anchor, True).over(ahead))
        .join(edge, [*keys, "_block"])
        .withColumn("_back", F.coalesce("_back", "_carry_back"))
        .withColumn("_ahead", F.coalesce("_ahead", "_carry_ahead"))
        .withColumns(
            {
                "prev_index": F.col("_back.i"),
                "prev_value": F.col("_back.v"),
                "next_index": F.col("_ahead.i"),
                "next_value": F.col("_ahead.v"),
            }
        )
        .drop("_block", "_back", "_ahead", "_carry_back", "_carry_ahead")
    )
