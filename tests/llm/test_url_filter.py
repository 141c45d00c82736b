from auklet.llm.registry import URL_RULES
from auklet.llm.url_filter import url_verdicts


def test_cases(spark):
    cases = {
        "http://net/": ("net", "/", "net/", "block"),
        "http://net": ("net", "", None, "allow"),
        "HTTPS://WWW.Example.NET/en/x?y=/z#q": ("www.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/x": ("example.net", "/EN/x", "net/", "block"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "http://a.b.example.com/de/": ("a.b.example.com", "/de/", "example.com/de/", "block"),
        "http://example.com/de": ("example.com", "/de", None, "allow"),
        "x://y://z.org/fr//a/": ("y:", "//z.org/fr//a/", None, "allow"),
        "http://org/fr/": ("org", "/fr/", "org/fr/", "allow"),
        "http://org/fr/a\nb/c": ("org", "/fr/a\nb/c", "org/fr/", "allow"),
        "http://org?/fr/": ("org", "", None, "allow"),
        "http://..net//": ("..net", "//", "net/", "block"),
        "no scheme.net/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://" + "a." * 300 + "net/" + "p/" * 300: ("a." * 300 + "net", "/" + "p/" * 300, "net/", "block"),
    }
    urls = list(cases) + ["http://net/"]
    pages = spark.createDataFrame([(k % 16 if u else None, u, 1) for k, u in enumerate(urls)], "page_id long, url string, host int")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    got = url_verdicts(pages, rules).collect()
    assert sorted(map(repr, ((r.url, (r.host, r.path, r.rule, r.verdict)) for r in got))) == sorted(repr((u, cases[u])) for u in urls)
    assert {r.verdict for r in url_verdicts(pages, rules.limit(0), otherwise="block").collect()} == {"block"}
    assert url_verdicts(pages.limit(0), rules).count() == 0


def test_repeated_rows_stay(spark):
    pages = spark.createDataFrame([(1, "http://net/")] * 3, "page_id long, url string")
    assert url_verdicts(pages, spark.createDataFrame(URL_RULES, "rule string, verdict string")).count() == 3


def test_very_long_urls(spark):
    """Hosts of 10,000 labels and paths of 100,000 segments cost no more than their length."""
    urls = ["http://" + "a." * 10_000 + "example.net/en/" + "p/" * 100_000, "http://" + "b" * 100_000 + ".org/fr/x", "http://" + "." * 50_000 + "net/" + "/" * 50_000, "http://" + "c." * 10_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule for r in url_verdicts(pages, spark.createDataFrame(URL_RULES, "rule string, verdict string")).collect()}
    assert got == {0: "example.net/en/", 1: "org/fr/", 2: "net/", 3: None}


def test_rules_of_any_shape(spark):
    rules = [("a.com/x", "block"), ("a.com/x/y/", "allow"), ("a.com/", "other"), ("com", "all"), ("b.a.com/", "b")]
    urls = {"http://a.com/xyz": "a.com/x", "http://z.a.com/x/y/z": "a.com/x/y/", "http://a.com/w": "a.com/", "http://q.com": "com", "http://b.a.com/x/y": "b.a.com/", "http://acom/": None, "://com": "com", "com/": None}
    pages = spark.createDataFrame([(None, u) for u in urls], "page_id long, url string")
    want = {u: max((r for r, _ in rules if (h := r.partition("/"))[0] and "://" in u and ((got := u.partition("://")[2].partition("/"))[0] == h[0] or got[0].endswith("." + h[0])) and (got[1] + got[2]).startswith(h[1] + h[2])), key=len, default=None) for u in urls}
    assert want == urls and {r.url: r.rule for r in url_verdicts(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()} == urls
