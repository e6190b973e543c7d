from __future__ import annotations

import pytest

from depgraph.llm import urls
from tests.conftest import rows

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "https://com/", "http://com", "http://a.com/x?q#f", "http://EXAMPLE.com/en/a",
    "http://example.com/EN/a", "http://www.example.com/en/b", "http://x.www.example.com/en/", "http://badexample.com/en/",
    "http://example.com/en", "ftp://a.net/es/1", "http://net/fr/", "http://a.net/de/", "http://a.net?x=/es/",
    "x://y://net/es/", "http://.com/", "http://a..com/", "http://example.com./en/", "http://é.com/ü", "http://example.com/en/a",
]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def judged(spark, found, rules, default="allow"):
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return urls.judge_urls(pages, table, default)


def test_rules_match_brute_force(spark):
    got = rows(judged(spark, URLS, RULES), "page_id", "host", "path", "rule", "verdict")
    assert sorted(got) == [(i, *brute(u, RULES)) for i, u in enumerate(URLS)]


def test_deeply_nested_rules_and_repeated_urls(spark):
    nested = [("a.b.c", "/" + "x/" * i, "block" if i % 2 else "allow") for i in range(6)] + [("b.c", "/x/x/", "allow")]
    found = [f"http://{h}/{'x/' * i}y" for h in ("a.b.c", "z.a.b.c", "b.c", "c") for i in range(8)] * 3
    got = rows(judged(spark, found, nested, "none"), "page_id", "host", "path", "rule", "verdict")
    assert sorted(got) == [(i, *brute(u, nested, "none")) for i, u in enumerate(found)]


def test_conflicting_and_unusable_rules(spark):
    rules = [("a.com", "/", "allow"), ("a.com", "/", "block"), (None, "/", "block"), ("b.com", "/?x", "block"), ("c.com", None, "block")]
    got = dict(rows(judged(spark, ["http://a.com/", "http://b.com/?x", "http://c.com"], rules), "page_id", "verdict"))
    assert got == {0: "block", 1: "allow", 2: "block"}


@pytest.mark.parametrize("found, rules", [([], RULES), (["http://a.com/"], [])])
def test_empty_tables(spark, found, rules):
    got = judged(spark, found, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert [r.verdict for r in got.collect()] == ["allow"] * len(found)


def test_clashing_columns_are_replaced(spark):
    pages = spark.createDataFrame([("http://a.com/x", "old", "old")], "url string, rule string, host string")
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    row = urls.judge_urls(pages, table).first()
    assert (row.host, row.rule) == ("a.com", "com/")
