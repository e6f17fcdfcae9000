"""Sharding by balanced label propagation. Native: DataFrame functions only.

Documents that share a group (equal texts) are linked by a star, so a document has one link to its group and no pair is
ever listed; a table of further links may be given. All rows are first dealt round robin along a hash. In each round every linked
row counts the shards of its neighbours, and asks for the one that holds most of them. Between two shards as many rows move one way as
the other: requests against requests, and what is left against unlinked rows, which may lie anywhere. So counts stay at most one apart
in every round, a group larger than a shard keeps as many rows together as room allows, and no row is dropped. Rounds end when
the number of open requests no longer falls, or none can be granted. The request counts per pair of shards (shards squared
rows at most) are the only thing that the driver reads.

Defined results: a null text counts as empty with size 1 and the checksum of no bytes; null doc_ids are rows like others, without
further links; repeated rows are rows of their own, and take each other's links; ties between shards go by a hash; very long texts are
only hashed; links to unknown documents and of a document to itself count nothing; an empty table gives an empty result; further
columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.ranks import numbered, unit
from quire.session import materialize


def _pair(rows: dict[tuple[int, int], int], a: Column, b: Column) -> Column:
    """Lookup of a small table by a pair of shards, 0 where the pair is missing."""
    if not rows:
        return F.lit(0)
    entries = [x for (i, j), n in sorted(rows.items()) for x in (F.lit(i * 65536 + j), F.lit(n))]
    return F.coalesce(F.create_map(*entries)[(a * 65536 + b).cast("int")], F.lit(0))


def _quotas(want: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> tuple[dict, dict]:
    """Moves allowed per (from, to), and unlinked rows that go the other way to make room."""
    allowed: dict[tuple[int, int], int] = {}
    displaced: dict[tuple[int, int], int] = {}
    room = dict(free)
    for i in range(shards):
        for j in range(i + 1, shards):
            swap = min(want.get((i, j), 0), want.get((j, i), 0))
            allowed[i, j] = allowed[j, i] = swap
    over = {key: n - allowed.get(key, 0) for key, n in want.items() if n > allowed.get(key, 0)}
    asked = {j: sum(n for (_, t), n in over.items() if t == j) for j in range(shards)}
    for (i, j), n in sorted(over.items()):
        more = min(n, free.get(j, 0) * n // asked[j], room.get(j, 0))
        if more > 0:
            allowed[i, j] = allowed.get((i, j), 0) + more
            displaced[j, i] = more
            room[j] -= more
    return {k: v for k, v in allowed.items() if v}, displaced


_STATE = ["doc_id", "size", "text_crc32", "_group", "_u", "shard"]


def _wishes(now: DataFrame, links: DataFrame | None) -> DataFrame:
    """``now`` with ``_to`` (the shard with most neighbours; null without any) and ``_links`` (rows of the group).

    Ties are broken by a hash of group and shard, so that equal texts wish for the same one.
    """
    held = now.groupBy("_group", "shard").agg(F.count(F.lit(1)).alias("_n"))
    pick = F.max_by("shard", F.struct("_n", F.xxhash64("_group", "shard")))
    best = held.groupBy("_group").agg(pick.alias("_to"), F.sum("_n").alias("_links"))
    best = best.withColumn("_to", F.when(F.col("_links") > 1, F.col("_to")))
    wished = now.join(best, "_group")
    if links is None:
        return wished
    places = now.where("doc_id is not null").select("doc_id", "shard")
    votes = links.join(places.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id"), "shard").agg(F.count(F.lit(1)).alias("_n"))
    of_group = votes.select("doc_id").distinct().join(now, "doc_id").select("doc_id", "_group").distinct().join(held, "_group")
    votes = votes.unionByName(of_group.select("doc_id", "shard", "_n")).groupBy("doc_id", "shard").agg(F.sum("_n").alias("_n"))
    own = votes.groupBy("doc_id").agg(F.max_by("shard", F.struct("_n", F.xxhash64("doc_id", "shard"))).alias("_own"))
    return wished.join(own, "doc_id", "left").withColumn("_to", F.coalesce("_own", "_to")).drop("_own")


def balanced_shards(documents: DataFrame, shards: int = 8, links: DataFrame | None = None, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of ``documents``; counts per shard are at most one apart.

    ``links(a, b)`` are pairs of doc_ids beside those that equal texts make.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(whole) + F.lit(1)).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).cast("long").alias("text_crc32"),
        F.sha2(whole.cast("binary"), 256).alias("_group"),
    )
    rows = rows.withColumn("_u", unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], "_u", ["doc_id", "_group"], "_at")
    now = materialize(rows.withColumn("shard", F.pmod("_at", F.lit(shards)).cast("int")).select(_STATE), "shards")
    total = now.count()
    if links is not None:
        known = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
        links = materialize(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "shard-links")
    open_before = None
    while True:
        marked = materialize(_wishes(now, links), "shard-wishes")
        asks = F.coalesce(F.col("shard") != F.col("_to"), F.lit(False))
        want = {(r["shard"], r["_to"]): r["n"] for r in marked.where(asks).groupBy("shard", "_to").agg(F.count(F.lit(1)).alias("n")).collect()}
        still = sum(want.values())
        if not want or (open_before is not None and still >= open_before):
            break
        open_before = still
        free = {r["shard"]: r["n"] for r in marked.where("_to is null").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        allowed, displaced = _quotas(want, free, shards)
        if not allowed:
            break
        # along the hash of the group, so that few groups are moved in part; a large group is spread by its share of all rows
        share = F.col("_links") / F.lit(float(max(total, 1)))
        place = unit(F.col("_group")) * (1 - share) + F.col("_u") * share
        ranked = numbered(marked.where(asks).withColumn("_g", place), ["shard", "_to"], "_g", ["_group", "doc_id"], "_k")
        ranked = ranked.withColumn(
            "shard", F.when(F.col("_k") < _pair(allowed, F.col("shard"), F.col("_to")), F.col("_to")).otherwise(F.col("shard"))
        )
        loose = numbered(marked.where("_to is null"), ["shard"], "_u", ["doc_id"], "_k").withColumn("shard", _leave(displaced, shards))
        kept = marked.where(~asks & F.col("_to").isNotNull())
        now = materialize(ranked.select(_STATE).unionByName(loose.select(_STATE)).unionByName(kept.select(_STATE)), "shards")
    return numbered(now, ["shard"], "_u", ["doc_id", "_group"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def _leave(displaced: dict[tuple[int, int], int], shards: int) -> Column:
    """Shard of an unlinked row with position ``_k`` in its shard, after the first ones have made room."""
    out = F.col("shard")
    for j in range(shards):
        start = 0
        for i in range(shards):
            n = displaced.get((j, i), 0)
            if n:
                here = (F.col("shard") == j) & (F.col("_k") >= start) & (F.col("_k") < start + n)
                out = F.when(here, F.lit(i)).otherwise(out)
                start += n
    return out
