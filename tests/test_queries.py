"""Registered queries against their SQL twins; ``QUIRE_ALL=1`` runs every one of them."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checkrun import TABLES, norm

SF = "/root/testdata/sf0.001"
QUICK = [
    "cues", "ads", "titles", "noise_tags", "repeat_headers", "reading_order", "landings", "ad_runs", "articles",
    "toc_links", "playlist", "normalize_text", "form_blanks", "html_sections", "paginate_words", "source_merge",
    "prompt_batches", "proof_lookup", "stream_goto", "stream_offsets",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(entry.oracle_sql()) if os.environ.get("QUIRE_ALL") else QUICK)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in rel.fetchall())


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
