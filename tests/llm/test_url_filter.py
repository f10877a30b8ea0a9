import random

import pytest
from pyspark.sql import functions as F

from lakevec.llm import url_filter as u

RULE_KIND = "host string, path string, verdict string"
ODD = [
    None, "", "no scheme", "http://", "://", "http://EXAMPLE.org/es/x", "http://example.org", "http://example.org/", "http://example.org?a=/es/", "https://a.b.example.org/es/#f", "http://notexample.org/es/",
    "http://example.org/en/12?x", "http://example.org/en/1", "http://example.org/en/", "http://example.org:80/es/", "http://u@com/fr/", "http://com/fr/", "http://x.com/de/y/z", "http://x.com//de/", "a://b://com/fr/",
    "http://.org/", "http://org./", "http://É.org/é/", "http://x.net/" + "a/" * 30_000, "http://" + "a." * 300 + "org/x\ny",
]


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host) :]
    path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


@pytest.mark.parametrize("entries", [u.TRIE_ENTRIES, 0], ids=["trie", "joins"])
def test_odd_urls_against_plain_rules(spark, entries):
    urls = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "page_id long, url string").repartition(3)
    got = u.judged(urls, spark.createDataFrame(u.RULES, RULE_KIND), trie_entries=entries).collect()
    assert sorted((r["_row"]["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == [(i, *plain(x, u.RULES)) for i, x in enumerate(ODD)]


@pytest.mark.parametrize("entries", [u.TRIE_ENTRIES, 0], ids=["trie", "joins"])
def test_random_rules_with_nested_hosts_paths_and_ties(spark, entries):
    rng = random.Random(3)

    def host():
        return ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))

    def path():
        return "".join(f"/{rng.choice(['', 'x', 'xy', 'xyz'])}" for _ in range(rng.randint(0, 3)))

    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(200)]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(600)]
    got = u.judged(spark.createDataFrame(list(enumerate(urls)), "k long, url string"), spark.createDataFrame(rules, RULE_KIND), "block", trie_entries=entries).collect()
    assert sorted((r["_row"]["k"], r["rule"], r["verdict"]) for r in got) == [(i, *plain(x, rules, "block")[2:]) for i, x in enumerate(urls)]


def test_clashing_columns_repeats_and_allowed(spark):
    rows = [(1, "http://com/de/", "r", "h", "v"), (1, "http://com/de/", "r", "h", "v"), (2, "http://com/fr/", "r", None, "v"), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string, verdict string")
    kept = u.allowed(pages, spark.createDataFrame(u.RULES, RULE_KIND))
    assert kept.columns == pages.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[2:], key=str)


def test_empty_tables_and_incomplete_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = spark.createDataFrame([(None, "/", "block"), ("b", None, "block"), ("b", "/", None), ("", "/", "block"), ("B", "/c", "allow"), ("b", "/c", "block")], RULE_KIND)
    assert [(r["rule"], r["verdict"]) for r in u.judged(pages, rules).collect()] == [("b/c", "block")]
    assert [(r["rule"], r["verdict"]) for r in u.judged(pages, rules.limit(0)).collect()] == [(None, "allow")]
    deep = spark.createDataFrame([("b", "/c" * 5000, "block"), ("b", "/c", "block")], RULE_KIND)
    assert [r["rule"] for r in u.judged(pages, deep).collect()] == ["b/c"]
    for entries in (10, 0):
        assert u.judged(pages.limit(0), rules, trie_entries=entries).count() == 0


def test_contract_query_equals_sql(spark, against_sql):
    against_sql(u.op11, u.OP11_SQL, "/root/testdata/sf0.01")
    found = u.op11(spark, "/root/testdata/sf0.01")
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"] and found.where(F.col("rule").isNotNull()).count() > 0
