"""URL filters: path-template trees per host. Native: DataFrame functions only.

Rules decide the urls they fit, and teach the rest. Per host a tree of path segments grows downwards, one level per round:

1. Variable segments become a wildcard: numbers, dates, long hexadecimal names, and any segment that holds too small a share of
   its node. A node therefore has a bounded number of literal branches, however many urls it holds.
2. Branches whose labels differ no more from the rest of the node than chance allows are merged into one.
3. The purity of a branch is its share of allowed labels, smoothed by the purity of its node (and that of a host by the share in the
   whole table). A url whose last node has a purity below one half is blocked.

Pages are never gathered by host: a level sends counts per segment, and what is decided about a node comes back as one row, which
is joined by salted keys.

Defined results: a null url and one without ``://`` have an empty host and path, and are judged like all urls of that host; urls that
are repeated are pages of their own and teach each; a null page_id is kept; without any label every purity is one half, which is
allowed; empty segments (doubled or closing slashes) are skipped; what follows the ``depth``-th segment is one segment, so very long
urls take no more rounds; an empty table gives an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SALTS = 16
DEPTH = 6
SUPPORT = 3
SHARE = 50
STRENGTH = 4.0
CRITICAL = 3.84
#: segments that are variable whatever their share (and the two marks of the tree, should a url hold them)
VARIABLE = r"\A(?:[0-9]+(?:[.][A-Za-z]+)?|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9a-fA-F-]{36}|[*~])\z"
HEXADECIMAL = r"\A[0-9a-fA-F]*[0-9][0-9a-fA-F]*\z"
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    host = F.regexp_extract(url, _URL, 1)
    host = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (verdict, rule) that fits, else null; equally long ones by the longer host, then by code point."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0]))
    tests = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")),
        )
        for v, h, p in ordered
    ]
    return F.coalesce(*tests, F.lit(None).cast("struct<verdict:string,rule:string>"))


def segments(path: Column, depth: int) -> Column:
    """Segments of a path; the last of ``depth`` ones holds all that follows."""
    every = F.filter(F.split(path, "/"), lambda x: x != "")
    long = F.concat(F.slice(every, 1, depth - 1), F.array(F.array_join(F.slice(every, depth, F.size(every)), "/")))
    return F.when(F.size(every) > depth, long).otherwise(every)


def _salted(table: DataFrame) -> DataFrame:
    return table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def smoothed(good: Column, bad: Column, prior: Column, strength: float) -> Column:
    return (good + strength * prior) / (good + bad + strength)


def branches(open_rows: DataFrame, support: int, share: int, strength: float, critical: float) -> DataFrame:
    """host, node, branches (map from segment to name and purity; the wildcard stands for all segments that have no entry)."""
    key = ["host", "node"]
    variable = F.col("seg").rlike(VARIABLE) | ((F.length("seg") >= 8) & F.col("seg").rlike(HEXADECIMAL))
    seg = F.when(variable, F.lit("*")).otherwise(F.col("seg"))
    kids = open_rows.groupBy(*key, seg.alias("seg")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max("purity").alias("up")
    )
    kids = materialize(kids, "url-branches")
    total = kids.groupBy(*key).agg(F.sum("k").alias("kt"), F.sum("g").alias("gt"), F.sum("b").alias("bt"), F.max("up").alias("up"))
    # salted: a node may have very many segments
    dealt = kids.where((F.col("seg") != "*") & (F.col("k") >= support)).withColumn("_salt", F.pmod(F.hash("seg"), F.lit(SALTS)))
    literal = (
        dealt.join(_salted(total.select(*key, "kt")), [*key, "_salt"])
        .where(F.col("k") * share >= F.col("kt"))
        .groupBy(*key)
        .agg(F.collect_list(F.struct("seg", "k", "g", "b")).alias("lits"))  # at most ``share`` entries
    )
    kind = "array<struct<seg:string,k:bigint,g:bigint,b:bigint>>"
    nodes = total.join(literal, key, "left").withColumn("lits", F.coalesce("lits", F.array().cast(kind)))

    def sums(field: str, of: str = "lits") -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda s, x: s + x[field])

    rest = F.struct(
        F.lit("*").alias("seg"), (F.col("kt") - sums("k")).alias("k"), (F.col("gt") - sums("g")).alias("g"), (F.col("bt") - sums("b")).alias("b")
    )
    nodes = nodes.withColumn("all", F.concat(F.filter("lits", lambda x: x["k"] > 0), F.array(rest).cast(kind)))

    def like(x: Column) -> Column:
        """No significant difference between the labels of a branch and those of the rest of its node."""
        n, m = x["g"] + x["b"], F.col("gt") + F.col("bt") - x["g"] - x["b"]
        p, q = (x["g"] + 0.5) / (n + 1.0), (F.col("gt") - x["g"] + 0.5) / (m + 1.0)
        pool = (F.col("gt") + 0.5) / (F.col("gt") + F.col("bt") + 1.0)
        return (n == 0) | (m == 0) | ((p - q) * (p - q) <= critical * pool * (1.0 - pool) * (1.0 / (n + 1.0) + 1.0 / (m + 1.0)))

    same = F.filter("all", lambda x: like(x) & (x["k"] > 0))
    nodes = nodes.withColumn("same", same)
    def entry(x: Column) -> Column:
        merged = like(x) & (x["k"] > 0) & (F.size("same") > 1)
        return F.struct(
            x["seg"].alias("key"),
            F.struct(
                F.when(merged, F.lit("~")).otherwise(x["seg"]).alias("name"),
                smoothed(
                    F.when(merged, F.col("jg")).otherwise(x["g"]), F.when(merged, F.col("jb")).otherwise(x["b"]), F.col("up"), strength
                ).alias("purity"),
            ).alias("value"),
        )

    nodes = nodes.withColumn("jg", sums("g", "same")).withColumn("jb", sums("b", "same"))
    return nodes.select(*key, F.map_from_entries(F.transform("all", entry)).alias("branches"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    depth: int = DEPTH,
    support: int = SUPPORT,
    share: int = SHARE,
    strength: float = STRENGTH,
    critical: float = CRITICAL,
) -> DataFrame:
    """page_id, host, path, rule, template, purity, verdict of each row of ``pages`` (page_id, url).

    ``rules`` are (verdict, host, path) and travel in the plan. A literal branch needs ``support`` pages and one
    ``share``-th of its node's; ``strength`` labels of the node's purity are added to those of a branch; ``critical`` bounds the squared
    difference over its variance below which branches are merged.
    """
    host, path = parts(F.col("url"))
    fit = fitting(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", fit)
    rows = rows.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce((F.col("fit.verdict") == "allow").cast("long"), F.lit(0)).alias("good"),
        F.coalesce((F.col("fit.verdict") == "block").cast("long"), F.lit(0)).alias("bad"),
        segments(F.col("path"), depth).alias("rest"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("_salt"),
    )
    rows = materialize(rows, "urls")
    hosts = rows.groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    every = rows.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    labelled = (every["g"] or 0) + (every["b"] or 0)
    prior = F.lit(float(every["g"] / labelled) if labelled else 0.5)
    hosts = hosts.select("host", smoothed(F.col("g"), F.col("b"), prior, strength).alias("purity"))
    level = materialize(rows.join(_salted(hosts), ["host", "_salt"]).withColumn("node", F.lit("")), "url-level")
    done = None
    for _ in range(depth + 1):
        closed = level.where(F.size("rest") == 0)
        done = closed if done is None else done.unionByName(closed)
        going = level.where(F.size("rest") > 0).withColumn("seg", F.get("rest", F.lit(0)))
        if going.isEmpty():
            break
        nodes = materialize(branches(going, support, share, strength, critical), "url-nodes")
        step = going.join(_salted(nodes), ["host", "node", "_salt"])
        step = step.withColumn("to", F.coalesce(F.element_at("branches", F.col("seg")), F.element_at("branches", F.lit("*"))))
        level = step.select(
            *[c for c in level.columns if c not in ("node", "purity", "rest")],
            F.concat("node", F.lit("/"), "to.name").alias("node"),
            F.col("to.purity").alias("purity"),
            F.slice("rest", 2, F.size("rest")).alias("rest"),
        )
        level = materialize(level, "url-level")
    verdict = F.when(F.col("good") > 0, "allow").when(F.col("bad") > 0, "block").when(F.col("purity") < 0.5, "block").otherwise("allow")
    return done.select("page_id", "host", "path", "rule", F.col("node").alias("template"), "purity", verdict.alias("verdict"))
