import random
import re

from skygauge.llm import url_filter
from skygauge.llm.queries import URL_RULES
from tests.llm.util import SF


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0].translate({c: c + 32 for c in range(65, 91)})
        path = re.split(r"[?#]", rest[len(host) :])[0]
    fits = [
        (h.count("."), len(p), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def check(spark, urls, rules, **more):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    for r in url_filter.judge(df, rules, **more).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"], rules), r["url"]


def test_pages(spark):
    check(spark, [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()], URL_RULES)


def test_random_urls_and_rules(spark):
    draw = random.Random(6)
    label = lambda: draw.choice(["a", "b", "com", "net", "www"])
    host = lambda: ".".join(label() for _ in range(draw.randrange(1, 4)))
    path = lambda: "/" + "".join(draw.choice(["a/", "b/", "ab", "//", "é/"]) for _ in range(draw.randrange(4)))
    rules = [(host(), path(), draw.choice(["allow", "block"])) for _ in range(80)]
    urls = [f"http://{host()}{path()}{draw.choice(['', '?q=/a', '#/b'])}" for _ in range(600)]
    check(spark, urls, rules)
    check(spark, urls, rules, block_rules=7)
    check(spark, urls, [])


def test_awkward_urls(spark):
    urls = [None, "", "no scheme", "://", "x://", "http://COM", "http://www.EXAMPLE.com/en/x", "a://b://c/d", "http://net/es/"]
    urls += ["http://example.com?/en/", "http://notexample.com/en/", "http://.com/", "http://a..net/fr/" + "x" * 100_000]
    check(spark, urls, URL_RULES)
    df = spark.createDataFrame([(1, "http://net/es/", "x", "y")] * 2, "page_id int, url string, _match string, rule string")
    out = url_filter.judge(df, URL_RULES).collect()
    assert [(r["_match"], r["rule"]) for r in out] == [("x", "net/es/")] * 2
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0
