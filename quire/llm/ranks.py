"""Positions and prefix sums inside a few very long groups, without gathering a group into one task.

Rows of a group are dealt into buckets that follow the order; a bucket is numbered in its own task, and only one summary row
per bucket passes through a window over the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def unit(*parts: Column) -> Column:
    """Uniform number in [0, 1) with 52 bits, drawn from the MD5 of the parts joined by a bar (the same in any SQL engine)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def numbered(df: DataFrame, group: Sequence[str], place: str, order: Sequence[str], out: str) -> DataFrame:
    """Gapless position from 0 per ``group``, along ``place`` (a double in [0, 1]) and then ``order``.

    Rows with equal ``place`` share a bucket; ``place`` should therefore come from a hash.
    """
    group = list(group)
    dealt = df.withColumn("_b", F.least(F.floor(F.col(place) * BUCKETS), F.lit(BUCKETS - 1)))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*group, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_b").orderBy(place, *order)
    return (
        dealt.withColumn("_r", F.row_number().over(inside) - 1)
        .join(starts, [*group, "_b"])
        .withColumn(out, (F.col("_from") + F.col("_r")).cast("long"))
        .drop("_b", "_r", "_from")
    )
