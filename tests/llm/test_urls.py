"""Rules against plain string tests, and the template tree on hosts whose labels are known."""

from __future__ import annotations

from quire.llm import urls

SCHEMA = "page_id long, url string, host int"


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail] + [len(tail)])]
    fit = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def run(spark, rows, **options):
    return [r.asDict() for r in urls.judge(spark.createDataFrame(rows, SCHEMA), **options).collect()]


def test_rules(spark):
    given = [
        "http://A.Example.ORG/es/5", "https://example.org/es", "https://example.org/en/1", "https://x.example.org/en/12?q", "http://org/", "http://org",
        "http://notexample.org/es/1", "http://shop.com/fr/a#x", "http://shop.com/de/", "http://shop.com/DE/", "http://com/de/b/c", "ftp://a.net//x//y/",
        None, "", "no scheme", "://", "http://É.com/fr/é", "http://a.com:80/fr/1", "http://h.org/p://q", "mailto:a://b.org/c\nd", "http://*.net/*/~/*",
        "http://deep.net/" + "/".join(str(i) + "x" for i in range(3000)), "http://long.net/" + "a" * 100_000, "http://a.org/en/1", "http://a.org/en/1",
    ]
    rows = [(i, u, 7) for i, u in enumerate(given)] + [(None, "http://null.org/x", 1)]
    got = sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in run(spark, rows))
    want = []
    for i, u, _ in rows:
        host, path, verdict, rule = brute(u)
        want.append((str(i), host, path, rule, verdict))
    assert got == sorted(want)


def test_longest_rule_wins(spark):
    rules = [("block", "a.b", "/"), ("allow", "b", "/a/"), ("block", "b", "/a/x"), ("allow", "b", "/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in run(spark, [(1, "x://a.b/a/", 0), (2, "x://c.b/a/xy", 0), (3, "x://c.b/q", 0)], rules=rules)}
    # of two rules of one length the one with the longer host
    assert got == {1: ("a.b/", "block"), 2: ("b/a/x", "block"), 3: ("b/", "allow")}


def test_templates(spark):
    rows = []
    for i in range(200):
        rows.append((len(rows), f"http://mix.com/de/{i}", 0))  # blocked by rule
        rows.append((len(rows), f"http://mix.com/news/{i % 7}/item-{i}", 0))
        rows.append((len(rows), f"http://mix.com/blog/{i % 3}", 0))
        rows.append((len(rows), f"http://good.org/a/b{i}", 0))  # allowed by rule
    got = {r["page_id"]: r for r in run(spark, rows)}
    by_url = {u: got[i] for i, u, _ in rows}
    # the host's labels are all bad, so its other branches, which nothing tells apart, are one merged branch and rejected
    assert by_url["http://mix.com/news/3/item-10"]["template"] == "/~/*/*"
    assert by_url["http://mix.com/blog/1"]["template"] == "/~/*"
    assert {by_url[u]["verdict"] for u in by_url if "mix.com" in u} == {"block"}
    assert by_url["http://good.org/a/b7"]["verdict"] == "allow" and by_url["http://good.org/a/b7"]["template"] == "/a/*"
    assert by_url["http://mix.com/blog/1"]["purity"] < 0.5 < by_url["http://good.org/a/b7"]["purity"]


def test_differing_branches_stay_apart(spark):
    rules = [("allow", "net", "/u/ok"), ("block", "net", "/u/bad"), ("allow", "net", "/v/")]
    rows = []
    for i in range(100):
        for u in (f"/u/ok/{i}", f"/u/bad/{i}", f"/u/new/{i}", f"/v/{i}", f"/w/{i}"):
            rows.append((len(rows), "s://h.net" + u, 0))
    got = {u: r for (_, u, _), r in zip(rows, sorted(run(spark, rows, rules=rules), key=lambda r: r["page_id"]), strict=True)}
    assert got["s://h.net/u/ok/1"]["template"] == "/u/ok/*" and got["s://h.net/u/bad/1"]["template"] == "/u/bad/*"
    assert got["s://h.net/u/bad/1"]["purity"] < 0.1 < 0.9 < got["s://h.net/u/ok/1"]["purity"]
    assert 0.4 < got["s://h.net/u/new/1"]["purity"] < 0.6
    assert got["s://h.net/v/1"]["purity"] > 0.9


def test_empty_table(spark):
    assert run(spark, []) == []
