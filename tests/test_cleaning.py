"""Cleaning rules on the cases they were made for."""

from __future__ import annotations

import pytest
from conftest import column
from pyspark.sql import functions as F

from quire.functions import noise as N
from quire.functions.joining import join_text
from quire.functions.sentences import sentence_list
from quire.operators import cleaning as C

CASES = [
    (C.dehyphenate, "state- of-the-art", "state-of-the-art"),
    (C.dehyphenate, "mi- crocomputer a- b- c", "microcomputer abc"),
    (C.repair_words, "micro processor and comput ing on a key board", "microprocessor and computing on a keyboard"),
    (C.repair_words, "speec h t he outpu t printe r", "speech the output printer"),
    (C.repair_words, "micro - processor ab - of cd", "microprocessor ab-of cd"),
    (lambda d: C.repair_words(d, level="extended"), "wh o th e des ign homc", "who the design home"),
    (lambda d: C.repair_words(d, level="extended"), "ex pc rimc nt a ti on", "experimentation"),
    (lambda d: C.repair_words(d, level="extended"), "x d a t a b a s e", "xdatabase"),
    (lambda d: C.repair_words(d, level="extended"), "lin eof code", "line of code"),
    (lambda d: C.repair_words(d, level="extended"), "micro-\nprocessor ABC-\nDEF Big-\nTop", "microprocessor ABCDEF Big-Top"),
    (C.merge_syllables, "see co m p ut er.", "see co m p ut er."),
    (C.merge_syllables, "larger zq m p ut er.", "larger zqmputer."),
    (C.merge_fragments, "publ ish ers and the xyz", "publ ishers and the xyz"),
    (C.expand_form_blanks, "NAME ____ pays $____ now ____", "your name here pays dollar amount here now"),
    (C.expand_form_blanks, "no blanks  here", "no blanks  here"),
    (C.normalize_signs, "12,45- 12.34+ 1976-1977 pages 12-14", "-12,45 +12.34 1976-1977 pages 12-14"),
    (C.expand_contractions, "I’ll say Don't and it's", "I will say Do not and it is"),
    (C.expand_abbreviations, 'Approx. 5 ft. No. 5, 3" by 6\' i.e. ca. 1976', "Approximately 5 feet Number 5, 3 inches by 6 feet that is. about 1976"),
    (C.strip_quotes, "the boy's \"dog\"", "the boys dog"),
    (C.clean_tokens, "~hello~ com***puter syn|thesis Chapter...... [x] ██ --- ,", "hello com puter synthesis Chapter ,"),
    (C.remove_table_noise, "| A | B |\n|---|---|\nText", "A B\nText"),
    (C.strip_boilerplate, "Circle 12 on inquiry card now", " now"),
    (C.clean_ocr, "| Good words here |\nx7k9p brftk rkdedpiHN\nall rights reserved", "Good words here"),
    (C.clean_for_speech, "+=====+=====+", ""),
    (C.clean_for_speech, "It's the com puter | 12,45- Owed", "It is the computer -12,45 Owed"),
    (C.normalize_text, "* mi-\ncrocomputer\n2) costs $____", "microcomputer costs dollar amount here"),
]


@pytest.mark.parametrize("job,before,after", CASES, ids=[str(i) for i in range(len(CASES))])
def test_cases(texts, job, before, after):
    assert column(job(texts(before))) == [after]


def test_runs_of_any_length(texts):
    """A run of tokens takes no stack frame per token; an overflow would end the executor."""
    said, glued = "go" + " and" * 20000, "zq" * 20000
    assert column(C.repair_words(texts(said), level="extended")) == [said]
    assert column(C.merge_syllables(texts("larger " + "zq " * 20000))) == [f"larger {glued} "]


def test_long_runs_in_scanned_text(texts):
    from quire.functions import cleaning as R

    said = "go" + " and" * 20000
    assert column(C.clean_ocr(texts(said))) == [said]
    df = texts("pages " + "b " * 20000, "x a\nb c, d", "no a b").withColumn("text", R.spaced_letters(F.col("text")))
    assert column(df) == ["pages " + "b" * 20000 + " ", "xabc, d", "no a b"]


def test_long_runs_in_speech_text(texts):
    said = "go" + " and" * 20000
    assert column(C.clean_for_speech(texts(said, f"| {said} |"))) == [said, said]


def test_joining(texts):
    df = texts(
        "microprocessor witha .\nmethod of inputing",
        "This ends here.\nNext sentence",
        "mi-\ncrocomputer",
        "state-\nof-the-art",
        "New-\nYork",
        "end\n, more\n'quoted",
    ).withColumn("text", join_text(F.col("text")))
    assert column(df) == [
        "microprocessor witha . method of inputing",
        "This ends here. Next sentence",
        "microcomputer",
        "state-of-the-art",
        "New-York",
        "end, more'quoted",
    ]


def test_sentences(texts):
    df = texts(
        "First sentence here. Second one follows!",
        "This is a longer clause, and it should stay together until the final period. Next sentence starts here.",
        "One line\n\nanother line",
    ).withColumn("text", sentence_list(F.col("text")))
    assert [len(x) for x in column(df)] == [2, 2, 2]


def test_flags(texts):
    df = texts("12 VDC Relay SPDT 4 amp $1.25 ea.", "a;b\"c,d (e:f x y z ;;", "------", "plain words", "")
    garbage = column(df.withColumn("text", N.garbage(F.col("text"))))
    assert garbage[0] is False and garbage[3] is False and garbage[4] is False
    assert column(df.withColumn("text", N.table_line(F.col("text")))) == [False, False, True, False, True]
    tokens = texts("x7k9p", "brftk", "rkdedpiHN", "z80", "word", "q", "Ek", "in", "1976")
    assert column(tokens.withColumn("text", N.gibberish_token(F.col("text")))) == [
        True, True, True, False, False, True, True, False, False,
    ]


def test_corrections_in_order(spark):
    pages = spark.createDataFrame([("i", 1, "teh cat"), ("j", 1, "teh cat")], "issue_id string, page_no int, text string")
    pairs = spark.createDataFrame(
        [("i", 2, "the", "THE"), ("i", 1, "teh", "the")], "issue_id string, ord int, wrong string, right string"
    )
    out = {r.issue_id: r.text for r in C.apply_corrections(pages, pairs).collect()}
    assert out == {"i": "THE cat", "j": "teh cat"}


def test_rules_with_hits_write_what_the_plain_jobs_write(texts):
    from quire.functions import cleaning as R

    df = texts(
        "NAME ____ and NAME __ x ____", "Circle 12 on reader card. Copyright 1976 BYTE\nAll rights reserved", 'say "it\'s" \'now\'', "plain", "", "a ___ b"
    )
    for rules, job in ((R.form_rules(), None), (R.boilerplate_rules(), C.strip_boilerplate), (R.quote_rules(), C.strip_quotes)):
        got = C.counted_rules(df, rules)
        if job:
            assert column(got) == column(job(df))
        assert all({h.rule for h in r.hits} == {name for name, _, _ in rules} for r in got.collect())
    forms = {r.id: {h.rule: h.n for h in r.hits if h.n} for r in C.counted_rules(df, R.form_rules()).collect()}
    assert forms == {0: {"your name here": 2, "rest of a blank": 1}, 1: {}, 2: {}, 3: {}, 4: {}, 5: {"rest of a blank": 1}}
    hits = {(r.pack, r.rule): (r.pages_hit, r.replacements) for r in C.rule_hits(df).collect()}
    assert hits["quotes", "apostrophe"] == (1, 3) and hits["form_blanks", "your name here"] == (1, 2)
    assert hits["contractions", "it's"] == (1, 1)
