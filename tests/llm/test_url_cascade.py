import random

import pytest

from attesta.llm import url_cascade

PAGES = "page_id long, url string, html string, host string, path string, listed string, key string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "", "x", "y", "z", "k") for i, u in enumerate(urls)], PAGES)


def listed(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


@pytest.mark.parametrize("most_bytes", [1 << 20, 300])
def test_membership_is_exact_over_the_universe(spark, most_bytes):
    r = random.Random(5)
    universe = [f"h{r.randrange(10**9)}.example.org" for _ in range(3000)]
    keys = universe[:400] + ["never.seen.net"]
    cascade = url_cascade.build(listed(spark, [*keys, None, keys[0]]), listed(spark, universe), most_bytes)
    assert (len(cascade.slices) > 1) == (most_bytes == 300) and any(len(s) > 1 for s in cascade.slices)
    rows = url_cascade.with_listed(listed(spark, universe), cascade, "key", "hit").collect()
    assert {r.key for r in rows if r.hit} == set(keys[:400])


def test_rules_hosts_and_odd_urls(spark):
    urls = [
        "http://A.COM/en/1", "http://example.com/en/73?x", "http://x.net/de/", "https://example.net/de/8.html", "http://m.org/es/9", "http://m.org/ES/9", "http://notcom/en/1", "http://bad.test/a", "http://www.bad.test/b#c",
        None, "", "no scheme", "http://", "ftp://h?q", "http://h#f", "a://b://c/d", "http://com/en", "http://x\ny.com/en/\n1",
    ]
    rows = {r.page_id: r for r in url_cascade.judge(pages(spark, urls), listed(spark, ["bad.test"])).collect()}
    want = [
        ("a.com", "/en/1", "com/en/", "block"), ("example.com", "/en/73", "example.com/en/7", "allow"), ("x.net", "/de/", "net/de/", "allow"), ("example.net", "/de/8.html", "example.net/de/8", "block"),
        ("m.org", "/es/9", "org/es/", "block"), ("m.org", "/ES/9", None, "allow"), ("notcom", "/en/1", None, "allow"), ("bad.test", "/a", None, "block"), ("www.bad.test", "/b", None, "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"), ("h", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("com", "/en", None, "allow"),
        ("x\ny.com", "/en/\n1", "com/en/", "block"),
    ]
    assert [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(len(urls))] == want


def test_empty_list_and_table(spark):
    assert [r.verdict for r in url_cascade.judge(pages(spark, ["http://h/x"]), listed(spark, [])).collect()] == ["allow"]
    assert url_cascade.judge(pages(spark, []), listed(spark, ["a.b"])).count() == 0
