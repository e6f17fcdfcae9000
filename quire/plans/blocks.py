"""Ordered operations over one long key without gathering that key into one task.

An issue may hold a third of all pages, so ``Window.partitionBy("issue_id")`` over rows is never used. The integer
order column is cut into fixed blocks: rows are handled per (key, block), which is at most ``block`` rows, and only one
summary row per block goes through a window over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _block_of(order: str, block: int) -> Column:
    return F.floor(F.col(order) / F.lit(block))


def with_seq(df: DataFrame, keys: Sequence[str], order: str, out: str, block: int = BLOCK) -> DataFrame:
    """Dense 1-based position per key. ``order`` is an integer column, unique inside a key."""
    keys = list(keys)
    blocked = df.withColumn("_blk", _block_of(order, block))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy(*keys, "_blk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(order)
    return (
        blocked.withColumn("_rn", F.row_number().over(inside))
        .join(starts, [*keys, "_blk"])
        .withColumn(out, (F.col("_start") + F.col("_rn")).cast("int"))
        .drop("_rn", "_start", "_blk")
    )


def with_running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, block: int = BLOCK
) -> DataFrame:
    """Inclusive running sum of ``value`` per key along the integer ``order``."""
    keys = list(keys)
    blocked = df.withColumn("_blk", _block_of(order, block))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy(*keys, "_blk")
        .agg(F.sum(value).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = (
        Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        blocked.withColumn("_rs", F.sum(value).over(inside))
        .join(starts, [*keys, "_blk"])
        .withColumn(out, F.col("_start") + F.col("_rs"))
        .drop("_rs", "_start", "_blk")
    )


def with_leads(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    payload: Sequence[str],
    steps: int,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``next1`` .. ``next<steps>``: structs of ``payload`` of the following rows of the key.

    ``order`` must be dense (see ``with_seq``). The first ``steps`` rows of a block are also sent to the block before
    it, so every block sees its successors; copies are dropped after the window.
    """
    keys = list(keys)
    blk = _block_of(order, block)
    targets = F.when(
        (F.col(order) % F.lit(block)) < F.lit(steps), F.array(blk, blk - F.lit(1))
    ).otherwise(F.array(blk))
    spread = df.withColumn("_blk", F.explode(targets))
    window = Window.partitionBy(*keys, "_blk").orderBy(order)
    packed = F.struct(*[F.col(c) for c in payload])
    out = spread
    for step in range(1, steps + 1):
        out = out.withColumn(f"next{step}", F.lead(packed, step).over(window))
    return out.filter(F.col("_blk") == blk).drop("_blk")


def with_nearest(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    flag: str,
    prev_out: str | None = None,
    next_out: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Order value of the nearest flagged row strictly before (``prev_out``) and after (``next_out``) each row."""
    keys = list(keys)
    blocked = df.withColumn("_blk", _block_of(order, block)).withColumn("_hit", F.when(F.col(flag), F.col(order)))
    summary = blocked.groupBy(*keys, "_blk").agg(F.min("_hit").alias("_lo"), F.max("_hit").alias("_hi"))
    by_block = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    by_block_desc = (
        Window.partitionBy(*keys).orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    summary = (
        summary.withColumn("_carry_prev", F.max("_hi").over(by_block))
        .withColumn("_carry_next", F.min("_lo").over(by_block_desc))
        .drop("_lo", "_hi")
    )
    up = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys, "_blk").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = blocked
    if prev_out:
        out = out.withColumn("_p", F.max("_hit").over(up))
    if next_out:
        out = out.withColumn("_q", F.min("_hit").over(down))
    out = out.join(summary, [*keys, "_blk"])
    if prev_out:
        out = out.withColumn(prev_out, F.coalesce("_p", "_carry_prev")).drop("_p")
    if next_out:
        out = out.withColumn(next_out, F.coalesce("_q", "_carry_next")).drop("_q")
    return out.drop("_blk", "_hit", "_carry_prev", "_carry_next")


def with_extremes(
    df: DataFrame, keys: Sequence[str], value: str, out: str, k: int = 2, largest: bool = False, block: int = BLOCK
) -> DataFrame:
    """Per key the ``k`` smallest (or largest) distinct values as an array; values are cut down per block first."""
    keys = list(keys)

    def cut(values: Column) -> Column:
        return F.slice(F.sort_array(values, asc=not largest), 1, k)

    per_block = (
        df.withColumn("_blk", _block_of(value, block)).groupBy(*keys, "_blk").agg(cut(F.collect_set(value)).alias("_v"))
    )
    return per_block.groupBy(*keys).agg(cut(F.flatten(F.collect_list("_v"))).alias(out))


def with_sorted_seq(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, total: str) -> DataFrame:
    """Dense position and row count per key for an order that is not a number.

    Rows are range-partitioned by key and order, so a long key spans many partitions. The placed rows are written once:
    the bounds of a range partitioning come from a sample and must not change between the two passes over them.
    """
    from quire.session import materialize

    keys, order = list(keys), list(order)
    placed = materialize(
        df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("_part", F.spark_partition_id()),
        "sorted",
    )
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_part")
    starts = (
        counts.withColumn(
            "_start", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        .withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)).cast("int"))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(starts, [*keys, "_part"])
        .withColumn(out, (F.col("_start") + F.col("_rn")).cast("int"))
        .drop("_rn", "_start", "_part")
    )
