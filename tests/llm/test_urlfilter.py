"""URL filter: the registered query, general rules against brute force, defined cases."""

import random

import pytest

from corpusloom.llm import urlfilter
from corpusloom.llm.urlfilter import RULE_SCHEMA, RULES, judge


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for rule_host, rule_path, verdict in rules:
        if rule_host is None or verdict is None:
            continue
        rule_host = "".join(c.lower() if c.isascii() else c for c in rule_host)
        rule_path = rule_path or ""
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            best = max(best or (), (len(rule_host + rule_path), len(rule_host), verdict == "block", rule_host + rule_path))
    return host, path, best[3] if best else None, ("block" if best[2] else "allow") if best else default


URLS = [
    None, "", "no scheme", "http://", "http://net/", "http://a.NET/x", "http://a.net", "http://a.net?/", "http://net.org/fr/x",
    "https://Example.net/en/1?x=/fr/", "https://m.example.net/en", "https://m.example.net/en/#top", "https://xexample.net/en/",
    "http://example.com/de/", "http://www.example.com/DE/", "http://user@example.com:80/de/", "ftp://a.org/fr/b", "x://y://org/fr/",
    "http://org/fr/\nz", "http://a..net/", "http://ÄB.org/fr/ü", "http://.net/", "http://a.org./fr/",
]


def rows_of(spark, urls, rules, **more):
    table = spark.createDataFrame([(i, u, "h", "p", 1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, path string, row int")
    rows = judge(table, spark.createDataFrame(rules, RULE_SCHEMA), **more).collect()
    assert len(rows) == len(urls)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}


def test_rules_of_the_query(spark):
    got = rows_of(spark, URLS, RULES)
    assert got == {i: brute(u, RULES) for i, u in enumerate(URLS)}
    verdicts = {URLS[i]: v[2:] for i, v in got.items()}
    assert verdicts["http://a.NET/x"] == ("net/", "block")
    assert verdicts["https://Example.net/en/1?x=/fr/"] == ("example.net/en/", "allow")
    assert verdicts["http://a.net"] == (None, "allow")


def test_rules_that_repeat_or_lack_something(spark):
    rules = [("a.b", "/x", "allow"), ("A.b", "/x", "block"), ("b", "/x/y", "block"), ("a.b", None, "allow"), (None, "/", "block"), ("b", "/", None), ("", "", "block")]
    urls = ["h://a.b/x", "h://a.b/x/y", "h://a.b", "h://c.b/x/y", "h://b/x", "", None, "h://c./q"]
    assert rows_of(spark, urls, rules, default="block") == {i: brute(u, rules, "block") for i, u in enumerate(urls)}


def test_random_rules(spark):
    draw = random.Random(7)
    hosts = lambda: ".".join(draw.choice(["a", "b", "ab", "c"]) for _ in range(draw.randint(1, 4)))
    paths = lambda: draw.choice(["", "/"]) + "".join(draw.choice("xy/") for _ in range(draw.randint(0, 4)))
    rules = [(hosts(), paths(), draw.choice(["allow", "block"])) for _ in range(150)]
    urls = [f"s://{hosts()}/{paths()}{draw.choice(['', '?q', '#f'])}" for _ in range(1500)]
    assert rows_of(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_rules_that_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "lookup_join", lambda a, b, on: __import__("corpusloom.session", fromlist=["x"]).lookup_join(a, b, on, limit=0))
    assert rows_of(spark, URLS, RULES) == {i: brute(u, RULES) for i, u in enumerate(URLS)}


def test_prefixes_that_collide(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "PREFIX", 0)
    assert rows_of(spark, URLS, RULES) == {i: brute(u, RULES) for i, u in enumerate(URLS)}


def test_long_urls_have_few_expressions(spark):
    long = "http://" + "a." * 20_000 + "org/fr/" + "x/" * 100_000
    assert rows_of(spark, [long], RULES) == {0: brute(long, RULES)}


def test_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    assert judge(none, rules).collect() == []
    rows = spark.createDataFrame([(None, "h://net/"), (1, "h://net/"), (1, "h://net/"), (1, "h://org/")], "page_id bigint, url string")
    got = sorted((r["page_id"] or 0, r["verdict"]) for r in judge(rows, rules).collect())
    assert got == [(0, "block"), (1, "allow"), (1, "block"), (1, "block")]
    assert {r["verdict"] for r in judge(rows, rules.limit(0)).collect()} == {"allow"}


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    pytest.importorskip("os").path.isdir(sf) or pytest.skip("no test tables")
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.op11_urlfilter(spark, sf).collect()}
    assert got == {i: brute(u, RULES) for i, u in pages.items()}
