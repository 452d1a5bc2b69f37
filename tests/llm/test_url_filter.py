import re

from pyspark.sql import functions as F

from quillon.llm import url_filter as uf

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/1?q#f", "http://www.example.com/en/", "https://a.www.example.com/en/x", "http://notexample.com/en/1", "http://example.com",
    "http://x.net/es/1", "http://net/fr/", "http://x.net/fr", "ftp://a.org/en/://b.com/", "http://.com/", "http://a.com:80/", "http://x.com?/en/", "http://É.com/x", "http://" + "a." * 3000 + "net/es/", "http://x.net/es/1",
]


def brute(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_against_brute_force(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    want = [(i, *brute(u)) for i, u in enumerate(URLS)]
    assert sorted(map(tuple, uf.judge(pages, RULES).collect())) == want
    monkeypatch.setattr(uf, "LITERAL_WORDS", 0)
    assert sorted(map(tuple, uf.judge(pages, RULES).collect())) == want
    assert uf.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in uf.judge(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 40_000, 37).selectExpr("concat('k', id) as key")
    cascade = uf.build(listed, universe)
    assert len(cascade.levels) >= 2
    got = universe.where(cascade.contains(F.col("key"))).count()
    assert got == universe.join(listed, "key", "left_semi").count()
    assert universe.where(cascade.contains(F.col("key"))).join(listed, "key", "left_anti").count() == 0
    assert universe.where(uf.build(listed.limit(0), universe).contains(F.col("key"))).count() == 0
