import random

from pyspark.sql import functions as F

from checks.compare import compare, duck
from gridloom.llm import common, url_filter
from gridloom.llm.queries import QUERIES, RULES, SQL


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "://", "http://", "http:///en/", "HTTP://A.Example.NET/en/x", "https://example.net", "https://example.net?x=/en/", "http://net/", "http://xnet/",
    "http://a.b.example.net/en/1#q", "http://example.net/EN/1", "http://example.com/de/", "http://example.com/de", "http://a.org/fr/1?x", "http://a.org/en", "a://b://net/x",
    "http://net./", "http://.net/x", "http://user@x.net:80/", "http://x.net/en/" + "y" * 100000, "http://É.NET/", "http://x.net/\nen", "http://x.net\n/en/",
]


def test_judge(spark):
    df = spark.createDataFrame([(i, u, "kept", "v") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    out = url_filter.judge(df, RULES)
    assert out.columns[:4] == df.columns
    for r in out.collect():
        assert (r._host, r._path, r._rule, r._verdict) == brute(r.url, RULES), r.url


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "FIRST_RATE", 0.5)
    rnd = random.Random(5)
    keys = [f"h{rnd.randrange(10**9)}.net/{i}" for i in range(6000)]
    universe = spark.createDataFrame([(k,) for k in [*keys, None, *keys[:50]]], "key string")
    listed = spark.createDataFrame([(k,) for k in [*keys[::7], None]], "key string")
    cascade = url_filter.build_cascade(universe, listed)
    assert len(cascade.parts[0]) > 2
    got = {r.key for r in universe.filter("key is not null").filter(cascade.holds(F.col("key"))).collect()}
    assert got == set(keys[::7])


def test_parts_when_a_filter_is_too_small_for_all_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BYTES", 256)
    keys = [f"k{i}" for i in range(4000)]
    universe, listed = (spark.createDataFrame([(k,) for k in some], "key string") for some in (keys, keys[::4]))
    cascade = url_filter.build_cascade(universe, listed)
    assert len(cascade.parts) > 4 and all(len(data) <= 256 for levels in cascade.parts for data, _, _ in levels)
    assert {r.key for r in universe.filter(cascade.holds(F.col("key"))).collect()} == set(keys[::4])


def test_rules_by_host_alone(spark):
    rules = [("example.com", "", "block"), ("a.example.com", "/x", "allow"), ("net", "", "allow"), ("b.net", "/", "block")]
    urls = [*URLS, "http://a.example.com/x", "http://a.example.com", "http://example.com?q", "http://b.net", "http://b.net/", "http://xexample.com/"]
    for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect():
        assert (r._host, r._path, r._rule, r._verdict) == brute(r.url, rules), r.url


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 2, 3, "old", "http://x.net/a")], "`_keys` int, `a.b` int, `row` int, `_host` string, url string")
    out = url_filter.judge(df, RULES)
    assert out.columns == ["_keys", "a.b", "row", "url", "_host", "_path", "_rule", "_verdict"]
    assert tuple(out.first()) == (1, 2, 3, "http://x.net/a", "x.net", "/a", "net/", "block")


def test_query(spark, sf):
    assert compare(spark, duck(sf), QUERIES["op7_url_filter"], SQL["op7_url_filter"], sf) == ""
