"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_attributes(rows: DataFrame, attributes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of many ``rows`` to one ``attributes`` row per key.

    One join, each side read once. ``rows`` is the outer side, so adaptive execution may cut the rows of a hot key into several
    tasks and read the single attribute row for each of them; small attribute tables are broadcast by Spark's own size check.
    """
    keys = list(keys)
    values = [c for c in attributes.columns if c not in keys]
    return rows.join(attributes, keys, "left").select(*rows.columns, *values)
