"""Which nodes of a graph reach which, for all nodes at once, by joins whose number follows the logarithm of the longest path.

After round t all pairs up to 2**t steps apart are known with their least distance. Any pair up to twice as far has a shortest
path through a node exactly 2**t steps from its start, so only such pairs are joined with everything known; they are few in a
graph of long chains, and no pair is derived through each of the nodes between its ends. Rounds are written to the shared folder,
which also cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize


def closure(edges: DataFrame, keys: Sequence[str] = ("issue_id",)) -> DataFrame:
    """``keys, a, b, d``: all pairs with a path from ``a`` to ``b`` of ``edges(keys, a, b)``, and its least number of steps.

    Every node that has an edge reaches itself in no steps.
    """
    keys = list(keys)
    pairs = edges.select(*keys, F.inline(F.expr("array(struct(a, b, 1 as d), struct(a, a as b, 0 as d), struct(b as a, b, 0 as d))")))
    pairs = materialize(pairs.groupBy(*keys, "a", "b").agg(F.min("d").alias("d")), "closure")
    step = 1
    while True:
        far = pairs.filter(F.col("d") == step).select(*keys, "a", F.col("b").alias("m"))
        if far.isEmpty():
            return pairs
        onward = pairs.filter("d > 0").select(*keys, F.col("a").alias("m"), "b", (F.col("d") + step).alias("d"))
        grown = pairs.unionByName(far.join(onward, [*keys, "m"]).select(*keys, "a", "b", "d"))
        pairs = materialize(grown.groupBy(*keys, "a", "b").agg(F.min("d").alias("d")), "closure")
        step *= 2
