import itertools

from dayglass.llm.url_filter import judge_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("a.b", "", "block"), ("B", "/x", "allow"), ("b", "/x", "block"), (None, "/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:at])
    path = rest[at:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:end]


def judged(url, rules):
    host, path = parts(url)
    fits = []
    for h, p, v in rules:
        if h is not None:
            h = h.lower()
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((len(h) + len(p), len(h), v, h + p))
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_against_direct_matching(spark):
    hosts = ["org", "example.org", "EXAMPLE.org", "notexample.org", "x.y.example.org", "a.b", "z.a.b", "b", ".org", "org.", "", "É.org"]
    tails = ["", "/", "/es/", "/es", "/en/1", "/en/12?x#y", "/en/2", "/x", "?q=/es/", "#/", "//es/", "/é/\n"]
    urls = [f"http://{h}{t}" for h, t in itertools.product(hosts, tails)] + [None, "", "no scheme/es/", "://org/", "a://b://example.org/es/"]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(0, urls[0], "again"), (None, urls[20], None), (None, urls[20], None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(str, map(tuple, judge_urls(pages, rules).collect())))
    assert got == sorted(str((i, *judged(u, RULES))) for i, u, _ in rows)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in judge_urls(pages, rules, default="block").collect()] == [(1, "a.b", "/c", None, "block")]
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
