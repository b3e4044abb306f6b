import random

import pytest

from loomtext.llm.queries import URL_RULES
from loomtext.llm.url_filter import Rule, UrlTrie, filter_urls, split_url


def brute(rules, host, path):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_trie_brute_force():
    r = random.Random(2)
    rules = [*URL_RULES, Rule("block", "a.b.net", "/x/y"), Rule("allow", "b.net", "/x/yz/"), Rule("block", "org", "/"), Rule("allow", "q.org", "")]
    trie = UrlTrie(rules)
    for _ in range(5000):
        host = ".".join(r.choice(["a", "b", "www", "example", "q", ""]) for _ in range(r.randint(0, 3))) + r.choice([".com", ".net", ".org", "com", ""])
        path = "".join(r.choice(["/", "en", "es", "x", "y", "z", "/en/", "/fr/"]) for _ in range(r.randint(0, 4)))
        path = "/" + path if path and path[0] != "/" else path
        assert trie.match(host, path) == brute(rules, host, path), (host, path)


@pytest.mark.parametrize(("url", "parts"), [("http://A.com/X?y#z", ("a.com", "/X")), (None, ("", "")), ("a.com/x", ("", "")), ("x://h", ("h", "")), ("x://h?q/a", ("h", "")), ("x://É.com#/", ("É.com", "")), ("a://b://c/d", ("b:", "//c/d"))])
def test_split(url, parts):
    assert split_url(url) == parts


def test_operator(spark):
    urls = ["http://www.example.com/en/1", "http://x.example.com/en/", "http://a.net/es/2", None, "", "http://a.com", "http://a.com/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(df, URL_RULES).collect()}
    assert got == {0: ("www.example.com/en/", "allow"), 1: ("example.com/en/", "block"), 2: ("net/es/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("com/", "allow")}
    assert filter_urls(df.limit(0), URL_RULES).count() == 0
    assert filter_urls(df, []).where("verdict = 'allow'").count() == 7
    with pytest.raises(ValueError):
        UrlTrie([Rule("maybe", "a", "/")])
