"""Steps whose cost per row must not grow with what else is in the row."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quire.functions import cleaning as E
from quire.functions import patterns as P
from quire.functions import scores as S
from quire.operators import cleaning as C
from quire.operators import links as K
from quire.operators import toc as T
from quire.plans import queries_ingest as I
from quire.plans import queries_links as Q
from quire.plans import views as V
from quire.sources import lines as L


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_run_of_many_fragments_needs_no_stack(texts):
    run = " ".join(["zz", "qa", "x"] * 30_000)
    out = C.merge_fragments(texts(run, f"start {run} the end", "co m p ut er")).orderBy("id").collect()
    glued = run.replace(" ", "")
    assert [r["text"] for r in out] == [glued, f"start {glued} the end", "computer"]


def test_grams_travel_without_their_title(spark):
    long = "a history of " + " ".join(f"machine{i}" for i in range(400))
    titles = spark.createDataFrame([("i", long), ("i", "short title")], "issue_id string, _low string")
    rows = T.gram_rows(titles.withColumn("_id", F.md5("_low")), ["_id"], "_low")
    assert rows.columns == ["issue_id", "_id", "_gram"]
    want = {long[i : i + 7] for i in range(len(long) - 6)} | {"short title"[i : i + 7] for i in range(5)}
    assert {r._gram for r in rows.collect()} == want
    contents = spark.createDataFrame([("i", 9, "x " + long + " y")], "issue_id string, page_no int, raw_text string")
    named = spark.createDataFrame([("i", 3, long.upper(), False), ("i", 4, "short title", False)], "issue_id string, page_no int, title string, skip_flag boolean")
    assert [(r.page_no, r.toc_page) for r in T.toc_index(contents, named).collect()] == [(3, 9)]


def test_lines_are_merged_once(spark):
    schema = "issue_id string, page_no int, line_no int, text string, left int, top int, width int, height int"
    rows = [("i", 1, 1, "The br0wn fox", 10, 10, 100, 12), ("i", 1, 2, "runs far", 10, 30, 100, 12)]
    scan = [("i", 1, 1, "The brown fox", 10, 10, 100, 12)]
    merged = L.merge_sources(spark.createDataFrame(rows, schema), spark.createDataFrame(scan, schema), "merge")
    assert optimized(merged).lower().count("zip_with(") <= 1
    assert [(r.line_no, r.text, r.source_kind) for r in merged.orderBy("line_no").collect()] == [
        (1, "The brown fox", "PDF+OCR"), (2, "runs far", "PDF"),
    ]


def test_words_are_grouped_where_their_page_is(spark, tmp_path, monkeypatch):
    texts = [None, "", "  \n \n", "one", "a  b   c \n\n d-\ne", *["\n".join(f"line {n} of  {k}" for n in range(k)) for k in range(12)]]
    rows = [(k, text, source) for k, (text, source) in enumerate((t, s) for t in texts for s in ("src1", "src5", "x 12", None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(V, "WORD_BYTES", 500)
    found = V.words(spark, str(tmp_path))
    held = sum(len(r[1].encode()) for r in rows if r[1])
    assert found.rdd.getNumPartitions() == -(-held // 500) > 4
    want = []
    for r in V.layout_lines(spark, str(tmp_path)).collect():
        at, wide = r.line_no - 1, r.n_lines >= 6
        place = (r.issue_id, r.page_no, at % 3 if wide else 0, 0, at // 3 if wide else at)
        cut = [w for w in r.text.split(" ") if w]
        want += [(*place, k, 5, w, r.left + 10 * k, r.top, 9, r.height) for k, w in enumerate(cut)]
        want += [(*place, 0, 4, r.text, r.left, r.top, r.width, r.height)] * (r.page_no % 4 == 0)
    assert sorted(map(tuple, found.collect())) == sorted(want) and {r[6] for r in want} == {4, 5}
    # the rows of words are neither shuffled nor are their lines: nothing is dealt above the cut into words
    for query in (I.span_blocks, I.span_lines, I.word_lines):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("Generate posexplode")], query.__name__


def test_skipped_searches_find_what_the_plain_ones_find(texts):
    parts = [
        "Order now", "order NOW buy", "buy", "1-800", "1 800", "% off", "5% OFF", "www.x", "$5", "know", "preorder", "Cashier's check",
        "ACT  now", "toll free", "ship me to", "while supplies last", "ONLY $", "new!x", "NEW!", "Cont'd on p. 12", "contd. from page 7",
        "CONTINUED ON 33", "cont on pg. 4", "__ ___", "BYTE MAG", "ÀÉÎ ABC", "aBC ABc", "reader service", "", "prose",
    ]
    rows = [*parts, " ".join(parts), ". ".join(reversed(parts))]
    df = texts(*rows).withColumnRenamed("text", "raw_text")
    c = F.col("raw_text")
    plain = lambda p: F.regexp_count(c, F.lit(p))
    words = lambda w: rf"(?i)(?:\b(?:{w})\b|www\.|\$)"
    numbers = lambda p: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda s: s.cast("int")))
    want = {
        "cue_hits": plain(words(P.AD_WORDS)),
        "cue_hits_web": plain(words(P.AD_WORDS_WEB)),
        "shout": F.regexp_like(c, F.lit(P.SHOUT)),
        "shout_web": F.regexp_like(c, F.lit(P.SHOUT_WEB)),
        "form_phrase": F.regexp_like(c, F.lit(P.FORM_AD)),
        "underscores": plain("_{2,}"),
        "caps2": plain(rf"(?<![{P.LATIN}])[{P.LATIN_UPPER}]{{2,}}(?![{P.LATIN}])"),
        "caps3": plain(rf"(?<![{P.LATIN}])[{P.LATIN_UPPER}]{{3,}}(?![{P.LATIN}])"),
        "caps_words": plain(r"(?<!\S)(?=\S*\p{Lu})(?!\S*\p{Ll})\S{3,}"),
        "continued_on": numbers(P.CONTINUED_ON),
        "continued_from": numbers(P.CONTINUED_FROM),
    }
    got = S.with_text_features(df).select("id", "raw_text", *want)
    both = got.select("id", *[F.col(k).alias(f"got_{k}") for k in want], *[v.alias(f"want_{k}") for k, v in want.items()]).collect()
    assert {(r["id"], k) for r in both for k in want if r[f"got_{k}"] != r[f"want_{k}"]} == set()


def test_link_jobs_compute_no_scores_of_the_web_profile():
    assert not {"cue_hits_web", "shout_web", "density_web"} & set(Q.FEATURES)
    assert not re.search("web", " ".join(Q.FEATURES))


def test_jumps_inside_an_island_add_no_pieces(spark):
    """Two islands of forty pages: jumps ahead, jumps back and later landings of one piece leave the pieces as they are."""
    pages = spark.createDataFrame([("i", p, False) for p in range(1, 81)], "issue_id string, page_no int, is_ad boolean")
    links = [(p, p + 1) for p in range(1, 80) if p != 40] + [(p, p + 4) for p in range(1, 30)]
    links += [(30, 20), (25, 10), (38, 33)] + [(p, p + 38) for p in range(12, 40)]
    edges = spark.createDataFrame([("i", a, b, "any") for a, b in links], "issue_id string, src int, dst int, kind string")
    placed, reach = K.article_segments(pages, edges)
    assert placed.select("seg").distinct().count() <= 6 and reach.count() <= 36
    starts = K.article_starts(pages, placed, reach)
    # pages 41 to 49 come before the first landing; nothing leads to them but their own island
    assert {(r.start_page, r.article) for r in starts.collect()} == {(p, 41 if 41 <= p < 50 else 50 if p >= 50 else 1) for p in range(1, 81)}
    runs = {(r.article, r.first_page, r.last_page) for r in K.article_runs(placed, reach, starts).collect()}
    assert runs == {(1, 1, 40), (1, 50, 80), (41, 41, 80), (50, 1, 80)}


def test_cleaning_patterns_look_behind_only_where_they_may_match(texts):
    """Searches open with a letter or a hyphen, and texts without a rule's words are not searched rule by rule."""
    assert E._opening(["soft|hard", "Re"]) == "(?=[hrs])" and E._opening(["a?b"]) == ""
    assert all(E._opening(w) for w in ([a for a, _ in P.SPLIT_WORDS], [a for a, _ in P.BROKEN_LETTERS], P.ABBREVIATIONS))
    rows = ["a well- known mi- crocomputer -x - y 3- d state- of-the", "Soft ware hard wares hardware re gister t he W hich outpu t out put", "plain", "", "é- à Dept 5"]
    rows += ["Circle 12 on inquiry card, see page 4", "xsee page 4", "NAME ___", "__", "Order yours now. MAIL coupon to us", "St. ca. 5 No. 6 i.e. x"]
    df = texts(*rows)
    plain = df.select("id", F.regexp_replace("text", F.lit(rf"(?<=[{P.W}])-\s+(?=[a-zà-öø-ÿ])(?!(?i:{'|'.join(P.CONNECTORS)})(?![{P.W}]))"), F.lit("")).alias("t"))
    plain = plain.select("id", F.regexp_replace("t", F.lit(rf"(?<=[{P.W}])-\s+(?=[a-zà-öø-ÿ])"), F.lit("-")).alias("t"))
    got = df.select("id", E.dehyphenate(F.col("text")).alias("t"))
    assert sorted(got.collect()) == sorted(plain.collect())
    for rules, needed in ((E.boilerplate_rules(), E.boilerplate_needed()), (E.form_rules(), "__"), (E.quote_rules(), "[\"']")):
        want = C.counted_rules(df, rules).orderBy("id").collect()
        assert C.counted_rules(df, rules, needed=needed).orderBy("id").collect() == want
