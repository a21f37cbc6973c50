import random
from collections import defaultdict

from pyspark.sql import functions as F

from forgepulse.llm.url_filters import RULES, absolute, host_of, keep_allowed, normal_form, path_of, url_filters

SCHEMA = "page_id long, url string, html string"


def rule(url, rules=RULES):
    """Host, path, rule and verdict of a url, read letter by letter."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def verdicts(df):
    return {r.page_id: (r.rule, r.verdict, r.source) for r in df.collect()}


def canonical(url):
    return f"<html><head><LINK href='{url}' data-x=1 rel=\"canonical\"></head><body>x</body></html>"


def test_parts_of_urls(spark):
    urls = [None, "", "plain", "a://b", "http://EXAMPLE.com", "http://x.Example.COM/en/1?q#f", "https://u:p@Host:80/p#f?x", "x://://a/b", "http://h?://c/d", "http://ÀB.com/É", "http://a\nb/c\nd", "://net/es/1"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    assert {r.url: (r.h, r.p) for r in df.collect()} == {u: rule(u)[:2] for u in urls}


def test_rules_of_the_contract(spark):
    urls = ["http://a.com/x", "http://a.com", "http://example.com/en/1", "http://x.example.com/en/", "http://www.example.com/en/1", "http://m.www.example.com/en/1", "http://example.com/de/1", "http://a.net/es/1", "http://a.net/es", "http://net/fr/1", "http://b.org/es/1", "http://xexample.com/en/1", None]
    got = verdicts(url_filters(pages(spark, [(i, u, None) for i, u in enumerate(urls)])))
    for i, u in enumerate(urls):
        _, _, r, v = rule(u)
        assert got[i] == (r, v or "allow", "rule" if v else "default"), u


def test_spellings_of_one_url(spark):
    same = ["http://a.org/x/y", "https://A.org:443/x/y/", "http://a.org:80//x/./y#top", "http://a.org./x/%79?utm_source=feed", "http://u@a.org/x/z/../y?utm_a=1&gclid=2"]
    other = ["http://a.org/x/Y", "http://a.org/x/y?page=2", "http://a.org/x/y.html", "http://b.a.org/x/y", "http://a.org/x%2Fy%3F", "http://a.org:8080/x/y"]
    form = lambda us: [r.n for r in spark.createDataFrame([(u,) for u in us], "u string").select(normal_form(F.col("u")).alias("n")).collect()]
    assert set(form(same)) == {"a.org/x/y"} and len({*form(other), "a.org/x/y"}) == len(other) + 1
    assert form(["nothing", None]) == [None, None]


def test_links_as_pages_mean_them(spark):
    base = "https://h.org/a/b?c#d"
    cases = {"http://x/y": "http://x/y", "//x/y": "https://x/y", "/r": "https://h.org/r", "s": "https://h.org/a/s", "#f": None, "mailto:a@b": None, "": None, " /q?a&amp;b ": "https://h.org/q?a&b"}
    df = spark.createDataFrame([(k, base) for k in cases], "l string, b string").select("l", absolute(F.col("l"), F.col("b")).alias("x"))
    assert {r.l: r.x for r in df.collect()} == cases


def test_decisions_reach_aliases_and_allow_goes_first(spark):
    rows = [
        (1, "http://a.org/1", canonical("http://b.org/1")),
        (2, "http://b.org/1/", '<meta http-equiv="refresh" content="0; URL=http://spam.net/es/9">'),  # blocked through two steps, by a url that no page has
        (3, "http://c.org/1", canonical("/2")),
        (4, "http://c.org/2#x", canonical("http://bad.net/fr/1")),
        (5, "http://c.org/3?url=http%3A%2F%2Fgood.com%2Fx", canonical("//c.org/1")),  # an allow in the component goes first
        (6, "http://d.org/1", None),
        (7, "http://bad.net/fr/1", canonical("http://good.com/")),  # its own rule stays
        (8, None, canonical("http://spam.net/es/9")),
        (9, "http://a.org/1?utm_source=x", None),  # a spelling of page 1
        (9, "http://a.org/1?utm_source=x", None),
        (10, "http://loop.org/", canonical("http://loop.org/")),
        (None, "http://e.net/%65s/1", None),  # a spelling of e.net/es/1
        (11, "http://e.net/es/1", None),
    ]
    df = pages(spark, rows)
    out = url_filters(df)
    assert out.count() == len(rows) and out.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    got = {k: v[1:] for k, v in verdicts(out).items()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "alias"), 4: ("allow", "alias"), 5: ("allow", "alias"), 6: ("allow", "default"), 7: ("block", "rule"), 8: ("allow", "default"), 9: ("block", "alias"), 10: ("allow", "default"), None: ("block", "alias"), 11: ("block", "rule")}
    assert sorted(str(r.page_id) for r in keep_allowed(df).collect()) == sorted(["3", "4", "5", "6", "8", "10"])


def test_random_links_equal_a_plain_search(spark):
    rng = random.Random(3)
    url = lambda: f"http://h{rng.randrange(60)}.{rng.choice(['org', 'org', 'org', 'org', 'net', 'com'])}/{rng.choice(['es', 'en', 'de', 'de'])}/{rng.randrange(3)}"
    rows = [(i, url(), canonical(url()) if rng.random() < 0.6 else canonical("http://hub.org/") if rng.random() < 0.3 else "") for i in range(300)]
    near, said = defaultdict(set), defaultdict(set)
    for _, u, html in rows:
        node = lambda x: x.split("://")[1].rstrip("/")
        said[node(u)].add(rule(u)[3])
        if html:
            v = html.split("href='")[1].split("'")[0]
            said[node(v)].add(rule(v)[3])
            near[node(u)].add(node(v))
            near[node(v)].add(node(u))
    want = {}
    for i, u, _ in rows:
        seen, todo = set(), [u.split("://")[1].rstrip("/")]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        every = set().union(*(said[x] for x in seen))
        want[i] = rule(u)[3] or ("allow" if "allow" in every else "block" if "block" in every else "allow")
    assert {k: v[1] for k, v in verdicts(url_filters(pages(spark, rows))).items()} == want and set(want.values()) == {"allow", "block"}


def test_empty_and_clashing(spark):
    df = pages(spark, [])
    assert url_filters(df).count() == 0 and keep_allowed(df).count() == 0
    more = pages(spark, [(1, "http://x.net/es/1", None)]).withColumns({"host": F.lit(1), "node": F.lit(2), "own": F.lit(3), "links": F.lit(4)})
    assert url_filters(more).first().verdict == "block" and keep_allowed(more).columns == more.columns
