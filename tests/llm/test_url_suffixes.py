"""Suffixes of two parts are a parameter."""

from gleaner.llm import url_filter


def test_sites_under_a_given_suffix_are_judged_apart(spark):
    rows = [(k, f"http://h.bad.com.cn/{k}") for k in range(200)] + [(k, f"http://y.good.com.cn/{k}") for k in range(200, 220)] + [(300, "http://x.good.com.cn/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(k, int(k < 200)) for k in range(220)], "page_id long, bad int")
    verdict = lambda **kw: {r.page_id: r.verdict for r in url_filter.judge(pages, outcomes, rules={}, **kw).collect()}[300]
    assert verdict() == "block" and verdict(two_part=(*url_filter.TWO_PART_SUFFIXES, "com.cn")) == "allow"
