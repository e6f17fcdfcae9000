"""Cues, landings, lookups, ad inserts and articles."""

from __future__ import annotations

import random

import pytest
from conftest import column
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.scores import cue_numbers
from quire.operators import ads as A
from quire.operators import features as D
from quire.operators import links as L
from quire.operators import playlist as R
from quire.operators import toc as T

PROSE = (
    "The story went on through the long winter and the people of the valley kept their old habits. "
    "They met every evening, talked about the harvest, and waited for letters. Nobody complained. "
    "Spring arrived late that year. The river carried broken branches towards the distant harbour. "
    "Children followed the boats along the bank."
)
AD = "UNBELIEVABLE!!! BUY NOW! ORDER TODAY! ONLY $5"


def _pages(spark, rows):
    return spark.createDataFrame(
        [("i", n, label, text) for n, (label, text) in enumerate(rows, start=1)],
        "issue_id string, page_no int, label string, raw_text string",
    )


def _chunks(pages):
    return pages.select(
        "issue_id", "page_no", F.posexplode(F.split("raw_text", "\n")).alias("chunk_no", "text")
    )


def _landing(spark, rows, target, profile="label_first"):
    pages = _pages(spark, rows)
    links = L.landing_chunk(L.landings(D.page_features(pages), None, profile), _chunks(pages))
    row = links.filter(F.col("target") == target).collect()[0]
    return row.dst_page, row.dst_chunk


def test_cue_variants(texts):
    on = texts(
        "… story continued on page 108.", "Continued on p. 108", "cont. on page 108", "continued on 108",
        "CONT. ON PAGE 12", "no jump here", "continued on page 3 and continued on p. 99",
    ).withColumn("text", cue_numbers("text", P.CONTINUED_ON))
    assert column(on) == [[108], [108], [108], [108], [12], [], [3, 99]]
    frm = texts("continued from page 14", "Continued from p. 14 — more", "cont. from page 14", "nothing").withColumn(
        "text", cue_numbers("text", P.CONTINUED_FROM)
    )
    assert column(frm) == [[14], [14], [14], []]


def test_label_numbers(texts):
    df = texts("Page 14", "page 108", "Page 3 · scan", "cover", "")
    assert column(df.withColumn("text", D.label_number(F.col("text")))) == [14, 108, 3, None, None]
    assert column(df.withColumn("text", D.label_number(F.lit("scan 7"), "web")))[0] == 7


def test_landings(spark):
    first = ("Page 14", "the adventure continued on page 108")
    assert _landing(spark, [first, ("Page 108", "continued from page 14 The hero")], 108) == (2, 0)
    assert _landing(spark, [first, ("Page 108", "Body without header.")], 108) == (2, 0)
    edge = ("Page 50", "— 108 —\ncontinued from page 14\nBody text.")
    assert _landing(spark, [first, edge], 108) == (2, 1)
    assert _landing(spark, [first, ("Page 1", "hello")], 108) == (None, None)
    three = [first, ("Page 108", "Unrelated page."), ("Page 200", "continued from page 14\nThe story resumes")]
    assert _landing(spark, three, 108) == (2, 0)
    assert _landing(spark, three, 108, "cue_first") == (3, 0)
    header = ("Page 108", "Magazine header junk\ncontinued from page 14\nThen the body")
    assert _landing(spark, [first, header], 108) == (2, 1)


def test_goto(spark):
    features = D.page_features(_pages(spark, [("Page 10", "a"), ("Page 11", "b"), ("Page 124", "x\ny\nz\n77")]))
    asked = spark.createDataFrame(
        [(1, "i", "11"), (2, "i", "124"), (3, "i", "2"), (4, "i", "77"), (5, "i", "x"), (6, "i", "0"), (7, "i", "999")],
        "request_id int, issue_id string, number string",
    )
    got = {r.request_id: (r.dst_page, r.status) for r in L.resolve_goto(asked, features).collect()}
    assert got == {
        1: (2, "found"), 2: (3, "found"), 3: (2, "found"), 4: (3, "found"), 5: (None, "not a number"),
        6: (None, "must be at least 1"), 7: (None, "not found"),
    }


def test_start_page_check(spark):
    pages = _pages(spark, [("Page 124", "a"), ("Page 125", "b")])
    asked = lambda n: spark.createDataFrame([("i", n)], "issue_id string, requested int")
    assert L.check_start(pages, asked(124)).count() == 0
    assert L.check_start(pages, asked(1)).count() == 0
    assert L.check_start(pages, asked(100)).count() == 1


def test_ad_page_between_article_pages_is_skipped(spark):
    pages = _pages(
        spark,
        [("Page 1", f"{PROSE} Continued on page 3"), ("Page 2", AD), ("Page 3", f"Continued from page 1\n{PROSE}")],
    )
    features = D.page_features(pages)
    skips = A.ad_skips(features, _chunks(pages))
    assert [(r.src_page, r.ad_page, r.dst_page) for r in skips.collect()] == [(1, 2, 3)]
    runs = A.ad_runs(features, skips)
    assert [(r.page_no, r.run_page, r.resume_page) for r in runs.collect()] == [(2, 2, 3)]
    edges = L.page_edges(features, runs)
    starts = spark.createDataFrame([("i", 3), ("i", 2)], "issue_id string, start_page int")
    got = sorted((r.start_page, r.page_no) for r in L.article_pages(features, edges, starts, runs).collect())
    assert got == [(2, 2), (3, 1), (3, 3)]


def test_ad_run_is_skipped_whole_but_not_at_the_end(spark):
    pages = _pages(spark, [("Page 1", PROSE), ("Page 2", AD), ("Page 3", AD), ("Page 4", PROSE), ("Page 5", AD)])
    features = D.page_features(pages)
    runs = A.ad_runs(features, A.ad_skips(features, _chunks(pages)))
    assert sorted((r.page_no, r.run_page, r.resume_page) for r in runs.collect()) == [(2, 2, 4), (3, 2, 4)]
    queue = {r.page_no: r.skipped for r in A.ad_queue(features, runs).collect()}
    assert queue == {2: True, 3: True, 5: False}


@pytest.mark.parametrize("profile,expected", [("page", 2), ("web", 2)])
def test_offset(spark, profile, expected):
    pages = _pages(spark, [("Page 1", "Cover"), ("Page 2", "Contents"), ("Page 3", f"{PROSE}\n1"), ("Page 4", f"{PROSE}\n2")])
    assert L.offset_first(D.page_features(pages), profile=profile).collect()[0].page_offset == expected
    vote = L.offset_vote(D.page_features(pages)).collect()[0]
    assert (vote.page_offset, vote.votes, vote.confirmed) == (2, 2, True)


def test_page_order_follows_jumps_and_stops_on_return(spark):
    steps = spark.createDataFrame(
        [("i", 1, 4), ("i", 2, 3), ("i", 3, 5), ("i", 4, 2), ("i", 5, 1)], "issue_id string, page_no int, next_page int"
    )
    got = [r.page_no for r in R.page_order(steps).orderBy("pos").collect()]
    assert got == [1, 4, 2, 3, 5]


def test_contents_page(spark):
    toc = spark.createDataFrame([("i", 1, "The Long Winter .... Harvest Time")], "issue_id string, page_no int, raw_text string")
    titles = spark.createDataFrame(
        [("i", 1, "Contents", False), ("i", 2, "The Long Winter", False), ("i", 3, "Harvest", False), ("i", 4, "Other story", False)],
        "issue_id string, page_no int, title string, skip_flag boolean",
    )
    assert sorted(r.page_no for r in T.toc_index(toc, titles).collect()) == [2, 3]


def test_file_names(texts):
    df = texts('A/B: "Story"  one', "", "x" * 90)
    assert column(df.withColumn("text", L.safe_stem(F.col("text")))) == ["AB Story one", "untitled", "x" * 79 + "…"]


def test_partial_issue_has_its_offset_and_gaps_keep_neighbours(spark):
    """An issue loaded from page 124 on has an offset; neighbours are positions, not page numbers."""
    rows = [("a", p, p, p - 4, [p - 4], [p - 4], [], [], False) for p in (124, 125, 126)]
    rows += [("b", p, None, None, [], [], [], [], False) for p in (1, 8, 14, 123)]
    f = spark.createDataFrame(
        rows,
        "issue_id string, page_no int, pdf_no int, folio int, folio_list array<int>, edge_folios array<int>, "
        "continued_on array<int>, continued_from array<int>, is_ad boolean",
    )
    got = {r["issue_id"]: (r["page_offset"], r["evidence_page"]) for r in L.offset_first(f).collect()}
    assert got == {"a": (4, 124), "b": (0, None)}
    edges = {(r["issue_id"], r["src"], r["dst"]) for r in L.page_edges(f).collect()}
    assert edges == {("a", 124, 125), ("a", 125, 126), ("b", 1, 8), ("b", 8, 14), ("b", 14, 123)}
    skipped = spark.createDataFrame([("b", 8), ("b", 14)], "issue_id string, page_no int")
    edges = {(r["issue_id"], r["src"], r["dst"]) for r in L.page_edges(f, skipped).collect()}
    assert edges == {("a", 124, 125), ("a", 125, 126)}


@pytest.mark.parametrize("seed", range(3))
def test_articles_of_all_starts(spark, seed):
    """Every start against walking back until nothing is added, then forward; jumps go both ways and may land inside an island."""
    rng = random.Random(seed)
    ads = {k: {p for p in range(1, 41) if rng.random() < 0.15} for k in "ab"}
    skipped = {k: {p for p in range(1, 41) if rng.random() < 0.08} for k in "ab"}
    links = set()
    for k in "ab":
        seen = [p for p in range(1, 41) if p not in skipped[k]]
        plain = [p for p in seen if p not in ads[k]]
        links |= {(k, a, b) for a, b in zip(seen, seen[1:], strict=False) if a in plain and b in plain and rng.random() < 0.8}
        links |= {(k, *rng.sample(plain, 2)) for _ in range(5)}
    pages = [(k, p, p in ads[k]) for k in "ab" for p in range(1, 41)]
    want = {}
    for k, p, ad in pages:
        found = {p}
        if not ad and p not in skipped[k]:
            for src, dst in ((2, 1), (1, 2)):
                grown = True
                while grown:
                    new = {x[dst] for x in links if x[0] == k and x[src] in found} - found
                    found |= new
                    grown = bool(new)
        want[k, p] = found
    features = spark.createDataFrame(pages, "issue_id string, page_no int, is_ad boolean")
    edges = spark.createDataFrame([(*x, "any") for x in sorted(links)], "issue_id string, src int, dst int, kind string")
    gone = spark.createDataFrame([(k, p) for k in "ab" for p in sorted(skipped[k])], "issue_id string, page_no int")
    placed, reach = L.article_segments(features, edges, gone)
    starts = L.article_starts(features, placed, reach)
    least = {(k, p): min(q for (i, q), s in want.items() if i == k and s == want[k, p]) for k, p in want}
    assert {(r.issue_id, r.start_page): r.article for r in starts.collect()} == least
    got = {}
    for r in L.article_runs(placed, reach, starts).collect():
        plain = {p for p in range(1, 41) if p not in ads[r.issue_id] | skipped[r.issue_id]} | {r.article}
        run = plain & set(range(r.first_page, r.last_page + 1))
        assert not got.setdefault((r.issue_id, r.article), set()) & run
        got[r.issue_id, r.article] |= run
    assert got == {key: want[key] for key in set((k, a) for (k, _), a in least.items())}
    asked = starts.select("issue_id", "start_page")
    listed = {}
    for r in L.article_pages(features, edges, asked, gone).collect():
        listed.setdefault((r.issue_id, r.start_page), []).append(r.page_no)
    assert {key: sorted(v) for key, v in listed.items()} == {key: sorted(v) for key, v in want.items()}


def test_titles_meet_contents_by_their_rarest_gram(spark):
    """Sixty titles with one opening on sixty contents pages: each meets only the page that holds its own ending."""
    toc = spark.createDataFrame([("i", 1000 + n, f"A history of computing, part {n:03d}x and more") for n in range(60)], "issue_id string, page_no int, raw_text string")
    titles = spark.createDataFrame(
        [("i", n, f"A history of computing, part {n:03d}x", False) for n in range(60)] + [("i", 70, "A history of computing, part 999x", False)],
        "issue_id string, page_no int, title string, skip_flag boolean",
    )
    grams = toc.select("issue_id", "page_no", F.explode(T._grams(F.lower("raw_text"))).alias("_gram"))
    rare = T.with_rarest_gram(titles.select("issue_id", F.lower("title").alias("_low")), grams)
    assert rare.count() == 60 and rare.join(grams, ["issue_id", "_gram"]).count() == 60
    got = {(r.page_no, r.toc_page) for r in T.toc_index(toc, titles).collect()}
    assert got == {(n, 1000 + n) for n in range(60)}
    chunks = toc.select("issue_id", "page_no", F.lit(0).alias("chunk_no"), F.col("raw_text").alias("text"), F.lit(False).alias("is_noise"))
    assert {(r.toc_page, r.dst_page, r.tier) for r in T.toc_links(chunks, titles).collect()} == {(1000 + n, n, 1) for n in range(60)}


@pytest.mark.parametrize("seed", range(4))
def test_page_order_is_the_walk(spark, seed):
    rng = random.Random(seed)
    steps, want = [], {}
    for issue in "abc":
        pages = sorted(rng.sample(range(1, 120), 60))
        onward = {p: q for p, q in zip(pages, pages[1:], strict=False)}
        for p in pages:
            if rng.random() < 0.3:
                onward[p] = rng.choice([q for q in pages if q > p] or pages) if rng.random() < 0.9 else rng.choice(pages)
        if issue == "c":
            onward.pop(pages[40], None)
        steps += [(issue, p, onward.get(p)) for p in pages]
        at, here = 0, pages[0]
        while here is not None and (issue, here) not in want:
            want[issue, here] = at
            at, here = at + 1, onward.get(here)
    df = spark.createDataFrame(steps, "issue_id string, page_no int, next_page int")
    assert {(r.issue_id, r.page_no): r.pos for r in R.page_order(df).collect()} == want


def test_texts_of_dumps_do_not_travel_to_each_article(spark):
    """Many articles of the same pages, parts over several blocks of pages, a page that comes twice."""
    from quire.sources.page_dump import format_dump, with_parts

    texts = [("i", n, f"Page {n}", " " if n % 50 == 0 else f"text {n} " * (n % 7 + 1)) for n in range(1, 700)] + [("i", 300, "Page 300", "again")]
    texts = spark.createDataFrame(texts, "issue_id string, page_no int, label string, raw_text string")
    seen = {s: [n for n in range(s, 700) if n % (s % 5 + 1) == 0 and (n < 300 or s % 2)] or [s] for s in range(1, 40)} | {250: [250, 260, 699], 698: [698]}
    articles = spark.createDataFrame([("i", s, n) for s, ns in seen.items() for n in ns], "issue_id string, start_page int, page_no int")
    features = spark.range(1, 700).select(F.lit("i").alias("issue_id"), F.col("id").cast("int").alias("page_no"), F.lit(None).cast("string").alias("title"))
    features = features.withColumns({"pdf_no": F.col("page_no"), "is_ad": F.lit(False)})
    key = ["issue_id", "start_page"]
    out = L.export_articles(articles, features, texts, F.lit("/x/BYTE_1976-08_a/scan.pdf"), part_bytes=1000)
    assert "raw_text" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.start_page, r.part): r.dump for r in out.collect()}
    parts = with_parts(articles.join(texts, ["issue_id", "page_no"]), key, "page_no", "label", "raw_text", 1000)
    # the two rows of page 300 may stand in either order
    plain = lambda dumps: {k: sorted(v.split("\n")) for k, v in dumps.items() if k[0] not in {r[0] for r in twice}}
    twice = {(s,) for s, ns in seen.items() if 300 in ns}
    want = {(r.start_page, r.part): r.dump for r in format_dump(parts, [*key, "part"], "page_no", "label", "raw_text").collect()}
    assert plain(got) == plain(want) and len(plain(want)) > 20
    for (s,) in twice:
        whole = lambda dumps: sorted("\n".join(v for k, v in sorted(dumps.items()) if k[0] == s).split("\n"))  # noqa: B023, E731
        assert [x for x in whole(got) if x] == [x for x in whole(want) if x]
    assert {k: v for k, v in got.items() if k[0] == 250} == {k: v for k, v in want.items() if k[0] == 250}


def test_a_written_table_leaves_no_shuffle_files(spark):
    import os
    import time

    from quire.session import materialize

    wide = spark.range(2000).select("id", F.repeat(F.md5(F.col("id").cast("string")), 100).alias("t")).repartition(3, "id")
    held = lambda: sum(f.endswith(".data") for d, _, fs in os.walk(local) for f in fs if f.startswith("shuffle_"))
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    local = os.path.dirname(disk.localDirsString()[0])
    before = held()
    out = materialize(wide, "wide")
    until = time.time() + 20
    while held() > before and time.time() < until:
        time.sleep(0.2)
    assert held() <= before and out.count() == 2000
