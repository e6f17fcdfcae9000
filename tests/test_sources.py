"""Readers, sinks and proof tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quire.operators import proofs as E
from quire.sources import documents as A
from quire.sources import images as I
from quire.sources import lines as L
from quire.sources import page_dump as D


def test_dump_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(
        [("i", 1, "Page 1", "hello\n\nworld"), ("i", 2, "cover", ""), ("i", 3, "Page 3", " x ")],
        "issue_id string, page_no int, label string, raw_text string",
    )
    D.write_dump(pages, str(tmp_path / "out"), tasks=2)
    got = {r.label: r.body for r in D.read_dump_files(spark, str(tmp_path / "out")).collect()}
    assert got == {"Page 1": "hello\n\nworld", "cover": "", "Page 3": "x"}


def test_long_dump_is_one_text_in_files_of_ascending_name(spark, tmp_path):
    pages = spark.range(1, 301).select(
        F.when(F.col("id") <= 280, "long").otherwise("short").alias("issue_id"), F.col("id").cast("int").alias("page_no"),
        F.concat(F.lit("Page "), F.col("id")).alias("label"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("raw_text"),
    )
    D.write_dump(pages.repartition(7), str(tmp_path / "out"), tasks=5)
    files = sorted((tmp_path / "out" / "issue_id=long").glob("part-*"))
    assert len(files) > 1
    whole = "".join(f.read_text() for f in files)
    assert whole == "".join(f"=== Page {n} ===\n{'é' * n}\n\n" for n in range(1, 281))
    read = D.read_dump_files(spark, str(tmp_path / "out"), folders=True)
    assert read.count() == 300 and read.select("path").distinct().count() == 2
    # the same as rows of bounded size: a part begins after every 10,000 bytes
    parts = D.with_parts(pages, ["issue_id"], "page_no", "label", "raw_text", 10_000)
    rows = D.format_dump(parts, ["issue_id", "part"], "page_no", "label", "raw_text").filter("issue_id = 'long'").orderBy("part").collect()
    assert "\n".join(r.dump for r in rows) == whole[:-1] and max(len(r.dump.encode()) for r in rows) < 10_000 + 600


def test_repeated_label_keeps_the_last_body(spark):
    docs = spark.createDataFrame([(1, "=== a ===\none\n=== a ===\ntwo\n"), (2, "no header")], "id int, text string")
    assert [(r.label, r.body) for r in D.read_dump(docs, ["id"]).collect()] == [("a", "two")]


def test_scan_of_mixed_folder(spark, tmp_path):
    files = {
        "my_note.md": "# Head\nintro *x*\n## Two\nbody",
        "page.html": "<html><title>T</title><body><nav><p>no</p></nav><h1>One</h1><p>a &amp; b<p>c</body></html>",
        "talk.srt": "1\n00:00:01,000 --> 00:00:02,000\n<i>Hello</i>\nthere.\n\n2\n00:00:03,000 --> 00:00:04,000\nBye.\n",
        "data.json": '[{"text": "one"}, "two", {"message": "three"}]',
        "rows.csv": 'a,,"c"\n1,2,3\n',
        "plain.txt": "just text",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got: dict[str, list] = {}
    for r in A.scan_documents(spark, str(tmp_path)).orderBy("path", "page_no").collect():
        got.setdefault(os.path.basename(r.path), []).append((r.title, r.text))
    assert got == {
        "my_note.md": [("Head", "Head\nintro x"), ("Two", "Two\nbody")],
        "page.html": [("One", "One\n\na & b\n\nc")],
        "talk.srt": [("talk", "Hello there.\n\nBye.")],
        "data.json": [("data", "one\n\ntwo\n\nthree")],
        "rows.csv": [("rows", "a: 1 · Col 2: 2 · c: 3")],
        "plain.txt": [("plain", "just text")],
    }


def test_pages_fill_up_to_the_word_target(spark):
    text = "\n\n".join(["word " * 99 + "end"] * 9)
    docs = spark.createDataFrame([(1, text, "T"), (2, "a\fb", "T"), (3, "", "T")], "id int, text string, title string")
    got = A.paginate(docs, ["id"]).collect()
    assert [len(r.text.split()) for r in got if r.id == 1] == [300, 300, 300]
    assert [(r.title, r.text) for r in got if r.id == 2] == [("T · Part 1", "a"), ("T · Part 2", "b")]
    assert [r.text for r in got if r.id == 3] == [""]


def test_image_catalogue(spark, tmp_path):
    for name in ("b.PNG", "A.jpg", "notes.txt", "c.tiff"):
        (tmp_path / name).write_bytes(b"x")
    got = [(r.name, r.label) for r in I.catalog_images(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [("A.jpg", "Image 1/3: A.jpg"), ("b.PNG", "Image 2/3: b.PNG"), ("c.tiff", "Image 3/3: c.tiff")]


def test_page_range(spark):
    pages = spark.range(1, 11).selectExpr("cast(id as int) page_no")
    assert [r.page_no for r in L.page_range(pages, 9, 20).collect()] == [9, 10]
    assert [r.page_no for r in L.page_range(pages, 1, 2, offset=3).collect()] == [4, 5]
    with pytest.raises(ValueError):
        L.page_range(pages, 5, 4)


def test_batches_keep_all_text(spark):
    text = "p" * 1500 + "\n\n" + "q" * 600 + "\n\n" + ("r" * 1200 + "\n") * 3 + "s" * 4500 + "\n\ntail"
    pages = spark.createDataFrame([("i", 1, text)], "issue_id string, page_no int, raw_text string")
    parts = [r.text for r in E.build_batches(pages).orderBy("batch_no").collect()]
    assert max(map(len, parts)) <= 2000
    assert "".join(parts).replace("\n", "") == text.replace("\n", "")
    assert [len(p) for p in parts] == [1500, 600, 1200, 1200, 1200, 2000, 2000, 500, 4]


def test_proof_intake_lookup_and_upsert(spark):
    results = spark.createDataFrame(
        [("i", 1, "Page 1", "```text\n[[SKIP_AS_AD]]\nBuy comput ing\n```", 1), ("i", 2, "PAGE 2", "body", 1)],
        "issue_id string, page_no int, label string, body string, version int",
    )
    parsed = {r.page_no: (r.body, r.is_ad) for r in E.parse_proofs(results).collect()}
    assert parsed == {1: ("Buy computing", True), 2: ("body", False)}
    pages = spark.createDataFrame(
        [("i", 1, "Page 1"), ("i", 2, "Page 2"), ("i", 3, "Page 1 · scan"), ("i", 4, "Page 9")],
        "issue_id string, page_no int, label string",
    )
    got = {r.page_no: r.match_tier for r in E.lookup_proofs(pages, results.select("issue_id", "label", "body")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: None}
    stored = spark.createDataFrame([("i", "a", "old"), ("i", "b", "keep")], "issue_id string, label string, body string")
    new = spark.createDataFrame(
        [("i", "a", "new", True), ("i", "c", "add", False)], "issue_id string, label string, body string, proofed boolean"
    )
    rows = lambda df: {r.label: r.body for r in df.collect()}
    assert rows(E.upsert_proofs(stored, new)) == {"a": "old", "b": "keep", "c": "add"}
    assert rows(E.upsert_proofs(stored, new, replace=True, only_proofed=True)) == {"a": "new", "b": "keep"}
    once = E.upsert_proofs(stored, new, replace=True)
    assert rows(E.upsert_proofs(once, new, replace=True)) == rows(once)


def test_anchoring_takes_all_lines_of_its_window_and_moves_forward(spark):
    lines = spark.createDataFrame(
        [("i", 1, 1, "alpha beta gamma", 10, 100, 50, 10), ("i", 1, 2, "delta epsilon zeta", 10, 120, 60, 10),
         ("i", 1, 3, "alpha beta again", 10, 300, 50, 10)],
        "issue_id string, page_no int, line_no int, text string, left int, top int, width int, height int",
    )
    proofs = spark.createDataFrame(
        [("i", 1, "Alpha beta gamma delta epsilon\n\nnothing shared here\n\nalpha beta again")],
        "issue_id string, page_no int, body string",
    )
    got = [(r.left, r.top, r.width, r.height) for r in E.anchor_proofs(proofs, lines).orderBy("para_no").collect()]
    assert got == [(10, 100, 60, 210), (10, 318, 60, 24), (10, 300, 50, 10)]


def test_triage(spark):
    lines = spark.createDataFrame(
        [("i", 2, n, t, 50, 100 + 20 * n, 300, 18) for n, t in enumerate(["good words are here " * 5, "<>~;=_`|/{}<>~;=_", "more fine words"], 1)],
        "issue_id string, page_no int, line_no int, text string, left int, top int, width int, height int",
    )
    pages = spark.createDataFrame([("i", 2, 800, 1100), ("i", 3, 800, 1100)], "issue_id string, page_no int, width int, height int")
    got = {r.page_no: (r.reason, r.x0, r.y0, r.x1, r.y1) for r in E.triage(lines, pages).collect()}
    assert got == {2: ("noisy_lines", 15, 80, 385, 238), 3: ("no_lines", None, None, None, None)}


def test_character_references_as_a_browser_reads_them(spark):
    import html
    import random

    from quire.functions.entities import LEGACY, decoded

    rng = random.Random(3)
    names = [n for n in html.entities.html5 if n.endswith(";")]
    given = ["caf&eacute; &amp;lt; &amp;amp;lt;", "&notit; &notin; &notin &ampx &AMP &unknown; & &; &#; &#x; a&b", "&#169;&#x2014;&#128;&#x9f;&#129;", "&#0;&#xD800;&#1114112;&#99999999999;", None, ""]
    given += ["".join(rng.choice(["&" + rng.choice(names), "&" + rng.choice(list(LEGACY)), "&" + rng.choice(names)[:-1], f"&#{rng.randint(32, 126)};", "x", " ", "é", ";"]) for _ in range(12)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    got = [r.d for r in df.select("i", decoded(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [None if t is None else html.unescape(t) for t in given]
    assert got[0] == "café &lt; &amp;lt;"


def test_blocks_are_trimmed_after_references_are_resolved(spark):
    df = spark.createDataFrame([("<html><title> &nbsp;T&eacute;&nbsp;</title><body><p>&nbsp; a&nbsp;b &amp;lt; &#160;</p></body></html>",)], "html string")
    sections = df.select(A.html_sections(F.col("html")).alias("s")).first().s
    assert [(s.title, s.text) for s in sections] == [("Té", "a b &lt;")]


def test_rich_text(spark, tmp_path):
    from quire.functions.rtf import pages_of

    assert pages_of(" plain {text} ") == ["plain {text}"]
    assert pages_of(r"{\rtf1{\fonttbl{\f0 A;}{\f1 B;}}{\*\x{\y z}}one\par two\line\tab three}") == ["one\ntwo\n three"]
    assert pages_of(r"{\rtf1 a\page b\sect\page c}") == ["a", "b", "c"] and pages_of(r"{\rtf1 }") == [""]
    assert pages_of(r"{\rtf1 caf\'e9 \u8212? \u-10179?\u-8704? \\\{\}\'zz \emdash\b0 x\~y}") == ["café — 😀 \\{}zz —x~y"]
    assert pages_of("{\\rtf1{\\info{\\title T}} a\r\nb} tail") == ["a\nb tail"]
    (tmp_path / "some_doc.rtf").write_text(r"{\rtf1 first\page second}")
    (tmp_path / "one.rtf").write_text(r"{\rtf1{\b only} page}")
    got = {(r.path.rsplit("/", 1)[1], r.page_no): (r.title, r.text) for r in A.scan_documents(spark, str(tmp_path)).collect()}
    assert got == {
        ("some_doc.rtf", 1): ("some doc · Page 1", "first"), ("some_doc.rtf", 2): ("some doc · Page 2", "second"),
        ("one.rtf", 1): (got["one.rtf", 1][0], "only page"),
    }


def test_readings_dealt_by_their_page_are_not_dealt_again(spark):
    """Readings of other lengths, pages that only one of them has, an issue without a name, a line that comes twice."""
    schema = "issue_id string, page_no int, line_no int, text string, left int, top int, width int, height int"
    line = lambda issue, page, no, text, top=0: (issue, page, no, text, 0, top, 10, 10)
    pdf = [line("i", 1, 2, "second line here"), line("i", 1, 1, "first line here"), line("i", 1, 3, "third line here"), line("i", 2, 1, "only printed")]
    pdf += [line(None, 1, 1, "nameless print"), line("i", 4, 1, "same line"), line("i", 4, 1, "same line")]
    ocr = [line("i", 1, 5, "f1rst line here"), line("i", 1, 7, "second lines here", 500), line("i", 3, 1, "only scanned"), line(None, 1, 1, "nameless scan")]
    dealt = [spark.createDataFrame(rows, schema).repartition(3, "issue_id", "page_no") for rows in (pdf, ocr)]
    out = L.merge_sources(*dealt, "merge")
    assert "ENSURE_REQUIREMENTS" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.issue_id or "", r.page_no, r.line_no, r.text, r.source_kind) for r in out.collect()) == [
        ("", 1, 1, "nameless print", "PDF"), ("", 1, 1, "nameless scan", "OCR"),
        ("i", 1, 1, "first line here", "PDF+OCR"), ("i", 1, 2, "second lines here", "PDF+OCR"), ("i", 1, 3, "third line here", "PDF"),
        ("i", 2, 1, "only printed", "PDF"), ("i", 3, 1, "only scanned", "OCR"),
        ("i", 4, 1, "same line", "PDF"), ("i", 4, 2, "same line", "PDF"),
    ]
