import re

from finescale.llm import urls
from finescale.llm.urls import Vocabulary

RULES = urls.RULES


def verdicts(spark, given):
    rows = [(i, u, "h", 1) for i, u in enumerate(given)]
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, host string, rule int")).orderBy("page_id").collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in got]


def test_parts_and_rules(spark):
    got = verdicts(spark, [
        "http://A.Example.NET/en/x?q#f", "https://net/", "https://net", "http://xnet/", "http://example.com/de/a", "http://m.example.com/dE/a",
        "http://w.org/fr/1", "no scheme", None, "", "x://h?u=http://evil.net/", "http://a.com#/net/", "http://É.net/ü", "://net/p"])
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("net", "/", "net/", "block"), ("net", "", None, "allow"),
        ("xnet", "/", None, "allow"), ("example.com", "/de/a", "example.com/de/", "block"), ("m.example.com", "/dE/a", None, "allow"),
        ("w.org", "/fr/1", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("h", "", None, "allow"), ("a.com", "", None, "allow"), ("É.net", "/ü", "net/", "block"), ("net", "/p", "net/", "block")]


def test_vocabulary_against_expressions(spark):
    given = ["http://porn.com/", "http://spornosport.com/", "http://casino-win.com/", "http://casino.com/", "http://poker.com/x/poker",
             "http://a.com/XXX", "http://a.com/xxxl", "http://adult-x.com/", "http://ads-track.com/a", "http://ads.com/?track",
             "http://free.com/" + "a" * 100_000 + "/bets", "http://casinowin.com/"]
    words = Vocabulary()
    for url, (_, _, rule, verdict) in zip(given, verdicts(spark, given)):
        text = re.sub(r"^[^:]*://([^?#]*).*", r"\1", url).lower()
        found = lambda t: re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", text) is not None
        blocked = any(map(found, words.strict)) or sum(map(found, words.soft)) >= words.soft_limit
        assert rule is None and verdict == ("block" if blocked else "allow"), url


def test_overlaps_and_empty(spark):
    a = Vocabulary(("ab-cd",), ("ab", "cd", "d"), 2).automaton()
    assert urls.hits(a, "ab-cd") == (1, {"ab", "cd"})
    assert urls.hits(a, "") == (0, set())
    assert verdicts(spark, []) == []
    twice = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://a.net/")], "page_id bigint, url string")
    assert [r.verdict for r in urls.judge(twice).collect()] == ["block"] * 3
