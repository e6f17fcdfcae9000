"""Links between pages: number offset, landings, lookups, page edges and articles."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.scores import cue_numbers
from quire.operators.features import issue_month, label_number
from quire.plans.blocks import with_leads, with_running_sum, with_seq
from quire.plans.closure import closure
from quire.plans.skew import join_attributes
from quire.session import materialize
from quire.sources.page_dump import PART_BYTES, section, trimmed_dump, with_parts_of

PAGE = ["issue_id", "page_no"]
#: Pages whose sections are held together while parts of dumps are made, and parts made from one copy of them.
DUMP_BLOCK, DUMP_PIECES = 256, 64


# --- offset between physical and printed numbers ---------------------------------------------------------------------


def offset_first(features: DataFrame, bound: int | None = None, profile: str = "page") -> DataFrame:
    """Offset of the first page with a readable number; 0 where none is found.

    The page profile takes the last candidate of a page, the web profile the first one inside the bound.
    """
    bound = bound if bound is not None else (15 if profile == "web" else 10)
    if profile == "web":
        offsets = F.transform("folio_list", lambda f: F.col("pdf_no") - f)
        offset = F.try_element_at(F.filter(offsets, lambda o: o.between(-bound, bound)), F.lit(1))
    else:
        offset = F.when((F.col("pdf_no") - F.col("folio")).between(-bound, bound), F.col("pdf_no") - F.col("folio"))
    hit = F.when(offset.isNotNull(), F.struct("page_no", offset.alias("o")))
    return (
        features.groupBy("issue_id")
        .agg(F.min(hit).alias("_first"), F.count(F.lit(1)).alias("n_pages"))
        .select(
            "issue_id",
            F.coalesce(F.col("_first.o"), F.lit(0)).alias("page_offset"),
            F.col("_first.page_no").alias("evidence_page"),
            "n_pages",
        )
    )


def offset_vote(features: DataFrame, bound: int = 10) -> DataFrame:
    """Most frequent offset, earliest evidence on ties; confirmed by two or more pages."""
    offset = F.col("pdf_no") - F.col("folio")
    votes = (
        features.withColumn("_o", F.when(offset.between(-bound, bound), offset))
        .groupBy("issue_id", "_o")
        .agg(F.count(F.lit(1)).alias("n"), F.min("page_no").alias("first"))
    )
    best = F.max(F.when(F.col("_o").isNotNull(), F.struct("n", (-F.col("first")).alias("f"), "_o")))
    return (
        votes.groupBy("issue_id")
        .agg(best.alias("_best"), F.sum("n").alias("n_pages"))
        .select(
            "issue_id",
            F.coalesce(F.col("_best._o"), F.lit(0)).alias("page_offset"),
            F.coalesce(F.col("_best.n"), F.lit(0)).alias("votes"),
            (-F.col("_best.f")).alias("evidence_page"),
            (F.coalesce(F.col("_best.n"), F.lit(0)) >= 2).alias("confirmed"),
            "n_pages",
        )
    )


def with_offset(pages: DataFrame, offsets: DataFrame | None) -> DataFrame:
    """Attach ``page_offset`` to page rows; None means 0 everywhere."""
    if offsets is None:
        return pages.withColumn("page_offset", F.lit(0))
    joined = join_attributes(pages, offsets.select("issue_id", "page_offset"), ["issue_id"])
    return joined.withColumn("page_offset", F.coalesce("page_offset", F.lit(0)))


# --- number lookups ----------------------------------------------------------------------------------------------------


def page_directory(features: DataFrame) -> DataFrame:
    """First page of an issue for each (kind, number): label, from-cue, edge number, edge number on a landing page."""

    def kind(name: str, numbers: Column) -> Column:
        return F.transform(numbers, lambda x: F.struct(F.lit(name).alias("kind"), x.cast("int").alias("number")))

    landing = F.when(F.size("continued_from") > 0, F.col("edge_folios")).otherwise(F.array().cast("array<int>"))
    entries = F.concat(
        F.when(F.col("pdf_no").isNotNull(), kind("label", F.array("pdf_no"))).otherwise(
            F.array().cast("array<struct<kind:string,number:int>>")
        ),
        kind("from", F.col("continued_from")),
        kind("edge", F.col("edge_folios")),
        kind("landing", landing),
    )
    return (
        features.select("issue_id", "page_no", F.inline(entries))
        .groupBy("issue_id", "kind", "number")
        .agg(F.min("page_no").alias("found"))
    )


def _resolve(requests: DataFrame, keys: list[str], tiers: list[tuple[str, Column]], directory: DataFrame) -> DataFrame:
    """First page in tier order for each request; null when no tier finds one.

    The directory has one row per (issue, kind, number), which ``join_attributes`` attaches to the lookups.
    """
    wanted = F.array(
        *[
            F.struct(F.lit(i + 1).alias("tier"), F.lit(kind).alias("kind"), number.cast("int").alias("number"))
            for i, (kind, number) in enumerate(tiers)
        ]
    )
    lookups = requests.select(*keys, F.inline(wanted)).filter("number IS NOT NULL")
    found = join_attributes(lookups, directory, ["issue_id", "kind", "number"]).filter("found IS NOT NULL")
    best = found.groupBy(*keys).agg(F.min(F.struct("tier", "found")).alias("_best"))
    return requests.join(best, keys, "left").select(
        *requests.columns, F.col("_best.tier").alias("tier"), F.col("_best.found").alias("dst_page")
    )


def landings(features: DataFrame, offsets: DataFrame | None = None, profile: str = "label_first") -> DataFrame:
    """Page where each "continued on" cue lands.

    Tiers: ``label_first`` label, landing page with that number, number at a page edge; ``cue_first`` puts the page whose
    from-cue names the source before the label; ``web`` label (offset or raw), from-cue naming the source, page edge.
    """
    base = with_offset(features.select("issue_id", "page_no", "pdf_no", "continued_on"), offsets)
    requests = base.filter(F.size("continued_on") > 0).select(
        "issue_id",
        F.col("page_no").alias("src_page"),
        (F.col("pdf_no") - F.col("page_offset")).alias("source"),
        "page_offset",
        F.explode("continued_on").alias("target"),
    )
    target, label, source = F.col("target"), F.col("target") + F.col("page_offset"), F.col("source")
    tiers = {
        "label_first": [("label", label), ("landing", target), ("edge", target)],
        "cue_first": [("from", source), ("label", label), ("landing", target), ("edge", target)],
        "web": [("label", label), ("label", target), ("from", source), ("edge", target)],
    }[profile]
    if profile == "web":
        # the web rule takes the first page that matches either label, so both labels form one tier
        out = _resolve(requests, ["issue_id", "src_page", "target"], tiers, page_directory(features))
        raw = _resolve(
            requests, ["issue_id", "src_page", "target"], [("label", target)], page_directory(features)
        ).select("issue_id", "src_page", "target", F.col("dst_page").alias("_raw"))
        out = out.join(raw, ["issue_id", "src_page", "target"], "left")
        return (
            out.withColumn("dst_page", F.when(F.col("tier") == 1, F.least("dst_page", "_raw")).otherwise(F.col("dst_page")))
            .withColumn("tier", F.when(F.col("tier") <= 2, 1).otherwise(F.col("tier") - 1))
            .drop("_raw", "page_offset")
        )
    return _resolve(requests, ["issue_id", "src_page", "target"], tiers, page_directory(features)).drop("page_offset")


def landing_chunk(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk of the landing page where the story resumes: from-cue naming the source, any from-cue, else 0."""
    cue_chunks = (
        chunks.filter(F.regexp_like("text", F.lit(P.CONTINUED_FROM)))
        .withColumn("_from", cue_numbers("text", P.CONTINUED_FROM))
        .groupBy(*PAGE)
        .agg(F.collect_list(F.struct("chunk_no", F.col("_from").alias("f"))).alias("_cues"))
        .withColumnRenamed("page_no", "dst_page")
    )
    named = F.array_min(
        F.transform(
            F.filter("_cues", lambda c: F.array_contains(c["f"], F.col("source"))), lambda c: c["chunk_no"]
        )
    )
    any_cue = F.array_min(F.transform("_cues", lambda c: c["chunk_no"]))
    return (
        links.join(cue_chunks, ["issue_id", "dst_page"], "left")
        .withColumn(
            "dst_chunk",
            F.when(F.col("dst_page").isNotNull(), F.coalesce(F.when(F.col("source").isNotNull(), named), any_cue, F.lit(0))),
        )
        .drop("_cues")
        .select(*links.columns, "dst_chunk")
    )


def resolve_goto(requests: DataFrame, features: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Page for each requested number, with a reason for the ones that stay open.

    Printed number first, then a number at a page edge, then the position in the issue (only where the offset is 0).
    """
    number = F.trim(F.col("number").cast("string")).try_cast("int")
    valid = requests.withColumn("_n", number)
    if offsets is not None:
        issue_attrs = offsets.select("issue_id", "page_offset")
    else:
        issue_attrs = features.select("issue_id").distinct().withColumn("page_offset", F.lit(0))
    distinct = valid.filter("_n >= 1").select("issue_id", "_n").distinct()
    asked = join_attributes(distinct, issue_attrs, ["issue_id"]).withColumn(
        "page_offset", F.coalesce("page_offset", F.lit(0))
    )
    directory = page_directory(features).unionByName(
        with_seq(features.select("issue_id", "page_no"), ["issue_id"], "page_no", "number").select(
            "issue_id", F.lit("index").alias("kind"), "number", F.col("page_no").alias("found")
        )
    )
    tiers = [
        ("label", F.col("_n") + F.col("page_offset")),
        ("edge", F.col("_n")),
        ("index", F.when(F.col("page_offset") == 0, F.col("_n"))),
    ]
    answers = _resolve(asked.select("issue_id", "_n", "page_offset"), ["issue_id", "_n"], tiers, directory)
    out = join_attributes(valid, answers.select("issue_id", "_n", "tier", "dst_page"), ["issue_id", "_n"])
    status = (
        F.when(F.col("_n").isNull(), "not a number")
        .when(F.col("_n") < 1, "must be at least 1")
        .when(F.col("dst_page").isNull(), "not found")
        .otherwise("found")
    )
    return out.withColumn("status", status).drop("_n")


def check_start(pages: DataFrame, requested: DataFrame) -> DataFrame:
    """Issues whose first loaded page does not carry the requested number.

    ``requested(issue_id, requested)``; labels without "page " and requests of page 1 are not checked.
    """
    first = pages.groupBy("issue_id").agg(F.min_by("label", "page_no").alias("label"))
    joined = requested.filter("requested > 1").join(first, "issue_id", "left")
    actual = label_number(F.col("label"))
    wrong = F.col("label").isNull() | (
        F.contains(F.lower("label"), F.lit("page ")) & (actual.isNull() | (actual != F.col("requested")))
    )
    return joined.withColumn("actual", actual).filter(wrong)


# --- page edges and articles ---------------------------------------------------------------------------------------------


def page_edges(features: DataFrame, skipped: DataFrame | None = None, offsets: DataFrame | None = None) -> DataFrame:
    """``issue_id, src, dst, kind``: neighbours that belong together (``next``) and cue jumps (``cue``).

    ``skipped(issue_id, page_no)`` are ad inserts the reader does not see.
    """
    cols = ["issue_id", "page_no", "pdf_no", "continued_on", "continued_from", "is_ad"]
    # positions among all loaded pages: page numbers may have gaps, and skipped pages keep their place
    pages = with_seq(with_offset(features.select(*cols), offsets), ["issue_id"], "page_no", "place")
    if skipped is not None:
        pages = pages.join(skipped.select(*PAGE).distinct(), PAGE, "left_anti")
    pages = pages.withColumn("printed", F.col("pdf_no") - F.col("page_offset")).drop("page_offset")
    payload = ["page_no", "place", "pdf_no", "printed", "continued_from", "is_ad"]
    ordered = with_leads(with_seq(pages, ["issue_id"], "page_no", "_seq"), ["issue_id"], "_seq", payload, 1)
    nxt = F.col("next1")
    linked = (
        F.coalesce(F.array_contains("continued_on", nxt["printed"]), F.lit(False))
        | F.coalesce(F.array_contains(nxt["continued_from"], F.col("printed")), F.lit(False))
        | ((F.size(nxt["continued_from"]) > 0) & (F.size("continued_on") > 0))
    )
    near = (nxt["place"] - F.col("place") <= 2) | F.coalesce(
        F.abs(nxt["pdf_no"] - F.col("pdf_no")).between(1, 2), F.lit(False)
    )
    neighbours = ordered.filter(nxt.isNotNull() & ~F.col("is_ad") & ~nxt["is_ad"] & (near | linked)).select(
        "issue_id", F.col("page_no").alias("src"), nxt["page_no"].alias("dst"), F.lit("next").alias("kind")
    )
    targets = pages.filter(~F.col("is_ad") & F.col("printed").isNotNull()).select(
        "issue_id", F.col("printed").alias("number"), F.col("page_no").alias("dst")
    )
    jumps = (
        pages.filter(~F.col("is_ad"))
        .select("issue_id", F.col("page_no").alias("src"), F.explode("continued_on").alias("number"))
        .join(targets, ["issue_id", "number"])
        .filter("src <> dst")
        .select("issue_id", "src", "dst", F.lit("cue").alias("kind"))
    )
    return neighbours.unionByName(jumps)


def _pieces(islands: DataFrame, jumps: DataFrame) -> DataFrame:
    """``islands`` with ``cut`` and the number ``seg`` of their piece: islands are cut where a jump lands.

    All pages between the ends of a jump that goes back inside its island lead to each other; they are not cut.
    """
    marks = jumps.select(
        "issue_id",
        F.inline(
            F.expr(
                "filter(array(struct(dst_pos as pos, 1 as landing, 0 as turn), "
                "if(src_isle = dst_isle, struct(dst_pos + 1 as pos, 0 as landing, 1 as turn), null), "
                "if(src_isle = dst_isle, struct(src_pos + 1 as pos, 0 as landing, -1 as turn), null)), m -> m is not null)"
            )
        ),
    )
    marks = marks.groupBy("issue_id", "pos").agg(F.max("landing").alias("landing"), F.sum("turn").alias("turn"))
    marked = islands.join(marks, ["issue_id", "pos"], "left").fillna(0, ["landing", "turn"])
    covered = with_running_sum(marked, ["issue_id"], "pos", "turn", "knots")
    cut = ((F.col("head") == 1) | ((F.col("landing") == 1) & (F.col("knots") == 0))).cast("int")
    return with_running_sum(covered.withColumn("cut", cut), ["issue_id"], "pos", "cut", "seg").select(*islands.columns, "cut", "seg")


def article_segments(features: DataFrame, edges: DataFrame, skipped: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(placed, reach)`` for the pages a reader sees that are no ads.

    ``placed(issue_id, page_no, seg)``: an island of pages of which each links to the next is cut where a jump lands; the pieces
    are numbered along the issue. An article always holds an island from its first page, so all pages of a piece have one article.
    Of the jumps of a piece to one island only the first landing is followed: whoever comes by another one has the piece behind
    it anyway, with all that leads to it, and reaches what follows. Fewer landings make larger pieces, and these fewer jumps.

    ``reach(issue_id, seg, reached)``: pieces of the article of each piece: all that follows from anything that leads to it. Both
    directions are one closure, over a backward and a forward copy of the pieces.
    """
    pages = features.filter(~F.col("is_ad")).select(*PAGE)
    if skipped is not None:
        pages = pages.join(skipped.select(*PAGE).distinct(), PAGE, "left_anti")
    seen = materialize(with_seq(pages, ["issue_id"], "page_no", "pos"), "places")
    place = lambda name: seen.select("issue_id", F.col("page_no").alias(name), F.col("pos").alias(f"{name}_pos"))
    links = edges.select("issue_id", "src", "dst").distinct().join(place("src"), ["issue_id", "src"])
    links = materialize(links.join(place("dst"), ["issue_id", "dst"]).withColumn("next", F.expr("dst_pos = src_pos + 1")), "links")
    chained = links.filter("next").select("issue_id", F.col("dst_pos").alias("pos"), F.lit(0).alias("head")).distinct()
    heads = seen.join(chained, ["issue_id", "pos"], "left").fillna(1, ["head"])
    islands = materialize(with_running_sum(heads, ["issue_id"], "pos", "head", "isle"), "islands")
    isle = lambda name: islands.select("issue_id", F.col("pos").alias(f"{name}_pos"), F.col("isle").alias(f"{name}_isle"))
    jumps = links.filter("NOT next").select("issue_id", "src_pos", "dst_pos")
    jumps = jumps.join(isle("src"), ["issue_id", "src_pos"]).join(isle("dst"), ["issue_id", "dst_pos"])
    # a jump ahead inside an island leads where the island leads
    jumps = materialize(jumps.filter("src_isle <> dst_isle OR dst_pos < src_pos"), "jumps")
    left = jumps.count()
    while True:
        placed = materialize(_pieces(islands, jumps), "segments")
        piece = lambda name, at=placed: at.select("issue_id", F.col("pos").alias(f"{name}_pos"), F.col("seg").alias(name))
        first = F.min(F.struct("dst_pos", "src_pos", "src_isle")).alias("j")
        kept = jumps.join(piece("src"), ["issue_id", "src_pos"]).groupBy("issue_id", "src", "dst_isle").agg(first)
        kept = materialize(kept.select("issue_id", "j.*", "dst_isle"), "jumps")
        before, left = left, kept.count()
        # any of the rounds may be the last one; they end when little is dropped any more
        if left >= 0.9 * before:
            break
        jumps = kept
    onward = placed.filter("cut = 1 AND head = 0").select("issue_id", (F.col("seg") - 1).alias("src"), F.col("seg").alias("dst"))
    jumps = kept.join(piece("src"), ["issue_id", "src_pos"]).join(piece("dst"), ["issue_id", "dst_pos"]).filter("src <> dst")
    steps = onward.unionByName(jumps.select("issue_id", "src", "dst")).distinct()
    # piece k as 2k looks back, as 2k + 1 ahead
    both = steps.select(
        "issue_id", F.inline(F.expr("array(struct(2 * dst as a, 2 * src as b), struct(2 * src + 1 as a, 2 * dst + 1 as b))"))
    )
    turns = placed.filter("cut = 1").select("issue_id", (2 * F.col("seg")).alias("a"), (2 * F.col("seg") + 1).alias("b"))
    pairs = closure(both.unionByName(turns)).filter("a % 2 = 0 AND b % 2 = 1")
    reach = pairs.select("issue_id", F.expr("a div 2").alias("seg"), F.expr("b div 2").alias("reached"))
    return placed.select(*PAGE, "seg"), reach


def article_starts(features: DataFrame, placed: DataFrame, reach: DataFrame) -> DataFrame:
    """``issue_id, start_page, article`` of every page: the smallest start page whose article has the same pages.

    A start on an ad, or on a page the reader does not see, is an article of its own.
    """
    h = F.xxhash64("reached")
    same = ["issue_id", "_n", "_sum", "_xor"]
    sets = reach.groupBy("issue_id", "seg").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(h.cast("decimal(38,0)")).alias("_sum"), F.bit_xor(F.xxhash64(h)).alias("_xor")
    )
    first = placed.groupBy("issue_id", "seg").agg(F.min("page_no").alias("first_page"))
    named = sets.join(first, ["issue_id", "seg"])
    named = named.join(named.groupBy(*same).agg(F.min("first_page").alias("article")), same).select("issue_id", "seg", "article")
    inside = placed.join(named, ["issue_id", "seg"]).select("issue_id", F.col("page_no").alias("start_page"), "article")
    return join_attributes(
        features.select("issue_id", F.col("page_no").alias("start_page")), inside, ["issue_id", "start_page"]
    ).withColumn("article", F.coalesce("article", "start_page"))


def article_runs(placed: DataFrame, reach: DataFrame, starts: DataFrame) -> DataFrame:
    """``issue_id, article, first_page, last_page``: the pages of each article of ``starts`` as runs.

    A run holds all seen pages between its ends that are no ads; a page without an article of others is a run of its own.
    """
    ends = placed.groupBy("issue_id", "seg").agg(F.min("page_no").alias("lo"), F.max("page_no").alias("hi"))
    own = starts.select("issue_id", "article").distinct()
    lead = own.join(ends.select("issue_id", "seg", F.col("lo").alias("article")), ["issue_id", "article"], "left")
    alone = lead.filter("seg IS NULL").select("issue_id", "article", F.col("article").alias("lo"), F.col("article").alias("hi"))
    held = lead.filter("seg IS NOT NULL").join(reach, ["issue_id", "seg"]).select("issue_id", "article", "reached")
    # pieces that follow each other differ from their rank by the same number
    ranked = with_seq(held, ["issue_id", "article"], "reached", "_k").withColumn("_k", F.col("reached") - F.col("_k"))
    whole = ranked.withColumnRenamed("reached", "seg").join(ends, ["issue_id", "seg"])
    runs = whole.groupBy("issue_id", "article", "_k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_k")
    return runs.unionByName(alone).select(
        "issue_id", "article", F.col("lo").cast("int").alias("first_page"), F.col("hi").cast("int").alias("last_page")
    )


def article_lists(placed: DataFrame, reach: DataFrame, starts: DataFrame) -> DataFrame:
    """``issue_id, article, page_no``: the pages of each article of ``starts``, one row each."""
    at = placed.select("issue_id", F.col("page_no").alias("article"), "seg")
    lead = starts.select("issue_id", "article").distinct().join(at, ["issue_id", "article"], "left")
    alone = lead.filter("seg IS NULL").select("issue_id", "article", F.col("article").alias("page_no"))
    held = lead.join(reach, ["issue_id", "seg"]).select("issue_id", "article", F.col("reached").alias("seg"))
    return held.join(placed, ["issue_id", "seg"]).select("issue_id", "article", "page_no").unionByName(alone)


def article_pages(features: DataFrame, edges: DataFrame, starts: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """``issue_id, start_page, page_no``: pages of the article each of ``starts(issue_id, start_page)`` belongs to.

    For all starts together see ``article_starts`` and ``article_runs``, which do not list pairs of pages.
    """
    placed, reach = article_segments(features, edges, skipped)
    asked = starts.select("issue_id", "start_page").distinct()
    known = asked.join(features.select("issue_id", F.col("page_no").alias("start_page")), ["issue_id", "start_page"])
    # lists by their start instead of the smallest start with the same pages
    listed = article_lists(placed, reach, known.withColumnRenamed("start_page", "article"))
    return listed.withColumnRenamed("article", "start_page")


def first_target_walk(features: DataFrame, starts: DataFrame) -> DataFrame:
    """Follow the first "continued on" target to the first unvisited page that has any from-cue or whose label
    contains the number; ends where a page has no cue or nothing is left to visit.

    After k visited pages the answer is among the first k+1 candidates of each kind, so only those are joined.
    """
    pages = features.select("issue_id", "page_no", "continued_on", "continued_from", "label")
    on = pages.filter(F.size("continued_on") > 0).select(
        "issue_id", F.col("page_no").alias("cur"), F.col("continued_on")[0].alias("target")
    )
    landing = materialize(
        with_seq(
            pages.filter(F.size("continued_from") > 0).select("issue_id", "page_no"), ["issue_id"], "page_no", "rank"
        ),
        "walk",
    )
    digits = F.regexp_extract_all("label", F.lit(r"\d+"), F.lit(0))
    pieces = F.flatten(
        F.transform(
            digits,
            lambda d: F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.length(d)),
                    lambda i: F.transform(
                        F.sequence(F.lit(1), F.least(F.lit(4), F.length(d) - i + 1)), lambda n: F.substr(d, i, n)
                    ),
                )
            ),
        )
    )
    named = materialize(
        with_seq(
            pages.select("issue_id", "page_no", F.explode(F.array_distinct(pieces)).alias("piece")).join(
                on.select("issue_id", F.col("target").cast("string").alias("piece")).distinct(), ["issue_id", "piece"]
            ),
            ["issue_id", "piece"],
            "page_no",
            "rank",
        ),
        "walk",
    )

    def candidates(asked: DataFrame, ranked: DataFrame, keys: list[str], depth: int) -> DataFrame:
        """Pairs of each walk with the first ``depth`` pages of its key."""
        heads = ranked.filter(F.col("rank") <= depth).groupBy(*keys).agg(F.collect_list("page_no").alias("_pages"))
        joined = join_attributes(asked, heads, keys)
        return joined.select("issue_id", "start_page", "visited", F.explode("_pages").alias("page_no"))

    state = starts.select(
        "issue_id", "start_page", F.col("start_page").alias("cur"), F.array("start_page").alias("visited")
    )
    parts = [state.select("issue_id", "start_page", F.lit(0).alias("ord"), F.col("cur").alias("page_no"))]
    for step in count(1):
        asked = state.join(on, ["issue_id", "cur"]).withColumn("piece", F.col("target").cast("string"))
        by_cue = candidates(asked, landing, ["issue_id"], step + 1)
        by_name = candidates(asked, named, ["issue_id", "piece"], step + 1)
        moved = (
            by_cue.unionByName(by_name)
            .filter(~F.array_contains("visited", F.col("page_no")))
            .groupBy("issue_id", "start_page")
            .agg(F.min("page_no").alias("cur"), F.first("visited").alias("visited"))
            .withColumn("visited", F.concat("visited", F.array("cur")))
        )
        state = materialize(moved, "walk")
        if state.isEmpty():
            break
        parts.append(state.select("issue_id", "start_page", F.lit(step).alias("ord"), F.col("cur").alias("page_no")))
    return reduce(DataFrame.unionByName, parts)


def safe_stem(title: Column, max_len: int = 80) -> Column:
    """File-system safe name: forbidden characters out, blanks collapsed, at most ``max_len`` characters."""
    s = F.regexp_replace(F.coalesce(title, F.lit("")), F.lit(r'[<>:"/\\|?*\x00-\x1f]+'), F.lit(""))
    s = F.trim(F.regexp_replace(s, F.lit(r"\s+"), F.lit(" ")), F.lit(" ."))
    cut = F.concat(F.rtrim(F.substring(s, 1, max_len - 1), F.lit(" .")), F.lit("…"))
    return F.when(s == "", "untitled").when(F.length(s) > max_len, cut).otherwise(s)


def export_articles(
    articles: DataFrame,
    features: DataFrame,
    texts: DataFrame,
    source_path: Column,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``issue_id, start_page, part, file_name, dump`` of each article.

    The lead page gives title and file name; ads with a long or continued title are called ``Ad p.N``. Long articles are
    cut into parts of about ``part_bytes`` so that no row grows with the size of an issue. ``texts`` hold the text to write (see
    ``preferred_text`` for proofread pages).
    """
    key = ["issue_id", "start_page"]
    leads = articles.groupBy(*key).agg(F.min("page_no").alias("page_no"))
    lead = leads.join(features.select(*PAGE, "title", "pdf_no", "is_ad"), PAGE)
    number = F.coalesce(F.when(F.col("pdf_no") > 0, F.col("pdf_no")), F.col("page_no")).cast("string")
    title = (
        F.when(
            F.col("is_ad")
            & (
                F.col("title").isNull()
                | (F.length("title") > 60)
                | F.startswith(F.lower("title"), F.lit("continued"))
            ),
            F.concat(F.lit("Ad p."), number),
        )
        .when(F.col("title").isNull(), F.concat(F.lit("Article p."), number))
        .otherwise(F.col("title"))
    )
    month = issue_month(source_path)
    stem = safe_stem(title)
    name = F.when(month.isNotNull(), F.concat(stem, F.lit(" - "), month, F.lit(".txt"))).otherwise(
        F.concat(stem, F.lit(".txt"))
    )
    lead = lead.select(*key, name.alias("file_name"))
    sections = texts.select(*PAGE, section("label", "raw_text").alias("section"))
    sections = sections.withColumn("size", F.octet_length("section").cast("long") + 1).filter("page_no IS NOT NULL")
    # a page that comes twice stands twice
    copy = F.row_number().over(Window.partitionBy(*PAGE).orderBy("section"))
    sections = materialize(sections.withColumn("row", F.struct("page_no", copy.alias("copy"))), "sections")
    body = articles.join(sections.select(*PAGE, "row", "size"), PAGE).join(lead, key)
    return _dumps(with_parts_of(body, key, "page_no", "size", part_bytes), sections)


def _dumps(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Dumps of ``pages(issue_id, start_page, part, file_name, page_no, row)``; a ``row`` of ``sections`` is unique in its issue.

    A page stands in many articles, so its text does not travel to them: sections move once, to the other ones of their block of
    pages, and a part that lies in one block is put together there. Only the pieces of the others meet by their part.
    """
    part = ["issue_id", "start_page", "part"]
    block = F.floor(F.col("page_no") / DUMP_BLOCK)
    pieces = pages.groupBy(*part, "file_name", block.alias("blk")).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    pieces = pieces.withColumn("pieces", F.count(F.lit(1)).over(Window.partitionBy(*part)))
    # some pieces of a block in one row: the texts of the block are not copied for each of them, and what they become is bounded
    along = Window.partitionBy("issue_id", "blk").orderBy("start_page", "part")
    some = pieces.withColumn("some", F.floor(F.row_number().over(along) / DUMP_PIECES)).groupBy("issue_id", "blk", "some")
    some = some.agg(F.collect_list(F.struct("start_page", "part", "file_name", "pieces", "rows")).alias("_p"))
    held = sections.groupBy("issue_id", block.alias("blk")).agg(F.map_from_entries(F.collect_list(F.struct("row", "section"))).alias("_s"))

    def joined(p: Column) -> Column:
        found = F.filter(F.transform(p["rows"], lambda n: F.element_at("_s", n)), lambda t: t.isNotNull())
        return F.struct(*[p[c].alias(c) for c in ("start_page", "part", "file_name", "pieces")], F.when(F.size(found) > 0, F.array_join(found, "\n")).alias("dump"))

    made = some.join(held, ["issue_id", "blk"]).select("issue_id", "blk", F.inline(F.transform("_p", joined)))
    ordered = F.array_sort(F.collect_list(F.struct("blk", "dump")))
    parted = made.filter("pieces > 1").groupBy(*part, "file_name").agg(F.array_join(F.transform(ordered, lambda e: e["dump"]), "\n").alias("dump"))
    every = made.filter("pieces = 1").select(*part, "file_name", F.coalesce("dump", F.lit("")).alias("dump")).unionByName(parted)
    return every.withColumn("dump", trimmed_dump(F.col("dump")))
