"""Rules, filter and exact join against plain Python."""

from planscope.llm import url_filter as u


def test_rules_and_list(spark):
    urls = [None, "no scheme", "HTTP://Example.ORG/es/1?x", "http://a.example.org/en/12", "http://x.org", "http://b.com/fr/#q", "http://b.com/de/",
            "http://www.bad.net/p/", "http://bad.net/p?u=1", "http://notexample.org/es/", "x://", "http://ok.net/\np"]
    pages = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(urls)] + [(8, urls[8], "again")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("bad.net/p",), ("bad.net/p",), (None,)], "canonical_url string")
    got = {r.page_id: r for r in u.filter_urls(pages, listed, u.RULES).collect()}
    rule = {i: r.rule for i, r in got.items() if r.rule}
    assert rule == {2: "example.org/es/", 3: "example.org/en/1", 5: "com/fr/", 6: "com/de/", 9: "org/"}
    assert {i for i, r in got.items() if r.verdict == "block"} == {2, 3, 6, 7, 8}
    assert (got[0].host, got[0].path, got[1].host, got[11].path) == ("", "", "", "/\np")
    assert u.filter_urls(pages, listed, u.RULES).count() == 13


def test_bloom_has_no_false_negative_and_join_removes_false_positives(spark):
    pages = spark.range(4000).selectExpr("id as page_id", "concat('http://h', id, '.net/') as url")
    listed = spark.range(0, 4000, 2).selectExpr("concat('h', id, '.net') as canonical_url")
    rows = u.filter_urls(pages, listed, [], blocks=64).collect()
    assert {r.page_id for r in rows if r.listed} == set(range(0, 4000, 2))
    assert sum(r.possible_hit for r in rows) > 2000
    none = u.filter_urls(pages, listed.limit(0), [])
    assert none.where("listed or possible_hit").count() == 0
    assert u.filter_urls(pages.limit(0), listed, []).count() == 0
