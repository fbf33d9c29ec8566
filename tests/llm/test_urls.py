import re

from tidemark.llm import urls
from tidemark.llm.queries import URL_RULES


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]


def rule_of(host, path):
    fits = [
        r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    None, "", "plain", "http://", "http://EXAMPLE.org/es/1", "http://m.example.org/en/12?x=/de/", "http://example.org",
    "http://Ärger.com/fr/x", "ftp://a.com/de/#x", "http://notexample.org/es/", "http://net/fr/", "x://y://z.com/de/",
    "http://a.com:80/de/", "http://a.com?/de/", "http://a.net/de/1", "\nhttp://a.com/de/\n",
] + [f"http://s{i}.example.com/{lang}/{i}" for i in range(40) for lang in ("de", "fr", "en")]


def test_rules_and_parts_match_brute_force(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string, host string")
    for r in urls.filter_urls(df, URL_RULES).collect():
        host, path = parts(URLS[r["page_id"]])
        rule = rule_of(host, path)
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (rule and rule.name)
        assert r["verdict"] == (rule.verdict if rule else r["verdict"]) and r["verdict"] in ("allow", "block")


def test_method_learns_from_the_ruled_urls(spark):
    rows = [(f"s{i}.example.com", f"/{'ads' if i % 2 else 'news'}/{i}", "block" if i % 2 else "allow") for i in range(200)]
    trained = urls.train(spark.createDataFrame(rows, "host string, path string, verdict string"))
    unseen = spark.createDataFrame([(f"t{i}.example.net", f"/{p}/{i}", p) for i in range(20) for p in ("ads", "news")], "host string, path string, p string")
    got = urls.score(unseen, trained).collect()
    assert sum((r["method_verdict"] == "block") == (r["p"] == "ads") for r in got) >= 38


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(none, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/x"), (None, None)], "page_id long, url string")
    assert [r["verdict"] for r in urls.filter_urls(one, URL_RULES).collect()] == ["allow", "allow"]
