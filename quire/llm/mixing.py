"""Mixing sources to target weights by Pareto order sampling. Native: DataFrame functions only.

A source's target divided by its size is the expected number of copies of each of its documents. The whole part of it is
taken for certain; the fraction is an inclusion probability. Documents are ranked by random odds over inclusion odds, and the
prefix whose words come nearest to what is left of the target is sampled. Ranks never gather a source into one task: they are
cut into buckets, one row per bucket and source is summed up, and only the bucket in which the prefix ends is ordered by row.

Defined results: a null text has size 0 and takes 0; null sources form one source, which is ordered last; a source of size 0
has target 0; an empty table gives an empty result; repeated rows are documents of their own; ties of rank are broken by
doc_id, then by size; further columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.ranks import BUCKETS, unit
from quire.session import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
SALTS = 16
#: the white space of a word pattern ``[^\x20\x09-\x0D]+``
SPACE = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    pieces = F.size(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"))
    opens = F.coalesce(text, F.lit("")).rlike(rf"\A(?:{SPACE}|\z)")
    closes = F.coalesce(text, F.lit("")).rlike(rf"{SPACE}\z")
    return (pieces - opens.cast("int") - closes.cast("int")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: source, source_size, target. Weights repeat along the code point order of the sources.

    Water filling in one pass: ordered by cap over weight, a source is capped as long as its cap lies below the level that
    the rest of the total would reach without it. This works on the table of sources, one row each.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.get(cycle, (F.row_number().over(every) - 1) % len(weights)))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    ordered = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = (
        per.withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_wleft", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_wleft"))
        .withColumn("_place", F.row_number().over(ordered))
        .withColumn("_first", F.min(F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.col("_place"))).over(whole))
        .withColumn("_at", F.max(F.when(F.col("_place") == F.col("_first"), F.col("_level"))).over(whole))
        .withColumn("_capped", F.col("_first").isNull() | (F.col("_place") < F.col("_first")))
    )
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_at") * F.col("_w"))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def pareto_mix(
    documents: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 17, text: str = "text"
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each row of ``documents``.

    ``documents`` needs doc_id, source and the text column. The same seed gives the same mix.
    """
    sizes = materialize(documents.select("doc_id", "source", word_count(F.col(text)).alias("size")), "mix-sizes")
    per = targets(sizes, weights, most).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.hash("doc_id"), F.lit(SALTS))
    joined = (
        sizes.withColumn("_salt", salt)
        .alias("d")
        .join(per.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d._salt") == F.col("p._salt")))
        .select("d.doc_id", "d.source", "d.size", "p.source_size", "p.target")
    )
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = unit(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_pi") / (1 - F.col("_pi")))
    drawn = (
        joined.withColumn("_sure", F.floor(copies))
        .withColumn("_pi", copies - F.col("_sure"))
        .withColumn("_u", u)
        .withColumn("_q", F.when(F.col("_pi") > 0, odds))
        .withColumn("_b", F.floor(F.col("_q") / (1 + F.col("_q")) * BUCKETS))
        .withColumn("_rest", F.col("target") - F.col("_sure") * F.col("source_size"))
    )
    # words below each bucket, then the bucket in which the rest of the target is reached
    below = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        drawn.where(F.col("_q").isNotNull())
        .groupBy("source", "_b")
        .agg(F.sum("size").alias("_in"), F.max("_rest").alias("_r"))
        .withColumn("_from", F.coalesce(F.sum("_in").over(below), F.lit(0)))
    )
    ends = (
        filled.where(F.col("_from") <= F.col("_r"))
        .groupBy("source")
        .agg(F.max("_b").alias("_end"), F.max_by("_from", "_b").alias("_before"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    placed = (
        drawn.withColumn("_salt", salt)
        .alias("d")
        .join(
            ends.alias("e"),
            F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d._salt") == F.col("e._salt")),
            "left",
        )
        .select("d.*", "e._end", "e._before")
    )
    inside = (
        Window.partitionBy("source", F.when(F.col("_b") == F.col("_end"), F.lit(-1)).otherwise(F.hash("doc_id")))
        .orderBy("_q", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    run = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    taken = (
        F.when(F.col("_q").isNull(), 0)
        .when(F.col("_b") < F.col("_end"), 1)
        .when(F.col("_b") > F.col("_end"), 0)
        .when(run + F.col("size") / 2 <= F.col("_rest"), 1)
        .otherwise(0)
    )
    return placed.withColumn("copies", (F.col("_sure") + taken).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies"
    )
