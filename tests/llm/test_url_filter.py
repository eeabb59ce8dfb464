from strata.llm import queries
from strata.llm import url_filter as U
from strata.llm.common import table

URLS = [
    None, "", "no scheme", "http://", "http://NET/x", "http://a.Net/x", "http://a.net", "http://a.net?x", "http://xnet/", "https://WWW.example.net/en/1?q#f", "https://example.net/en", "https://example.net/En/1",
    "ftp://x.example.com/de/5", "http://example.com/de/", "http://example.com/de", "http://a.org/fr/", "http://org/fr/x/y", "http://a.org#/fr/", "http://ÄÖ.example.org/fr/é", "x://y://z.net/p", "http://u:p@h.net:80/a", "http://a.net/\n/b", "http:// .net/" + "a" * 50_000,
]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
        path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fit = [(r, v) for r, v in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict or ("block" if U.default_model().probability(host, path) >= 0.5 else "allow")


def test_awkward_urls(spark):
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}
    assert U.judge_urls(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op8_url_filter(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.page_id: brute(r.url) for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}


def test_model_on_fresh_rows():
    model = U.default_model()
    fresh = U.training_table(seed=99)
    assert sum((model.probability(h, p) >= 0.5) == bool(y) for h, p, y in fresh) / len(fresh) > 0.95
