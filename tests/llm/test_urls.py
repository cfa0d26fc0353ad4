"""URL filters against a plain reading of the rules."""

import random

import pytest

from punctuality.llm import urls

RULES = [
    ("com", "/", "allow"),
    ("Example.COM", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("a.net", "/e", "block"),
    ("a.net", "/e", "allow"),  # block counts
    ("", "", "block"),
    ("b.net", "", "block"),
    ("a.b.net", "/x/yy/z", "allow"),
    (None, "/", "block"),
    ("net", None, "block"),
]


def plain(url, rules, default="allow"):
    rest = url.partition("://")[2] if url and "://" in url else ""
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))]
    fits = []
    for h, p, v in rules:
        if h is None or p is None:
            continue
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v == "block", h + p, v))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def made(n):
    rng = random.Random(12)
    hosts = ["www.Example.com", "example.com", "x.example.com", "com", "a.net", "q.a.net", "a.b.net", "b.net", "net", "evilexample.com", "ÄB.net", "example.com:80", "a..net", "com.", ".com", ""]
    paths = ["", "/", "/en", "/en/", "/en/a/b/c", "/e", "/es/x", "/x/yy/zz", "/x/yy/", "//en/", "/EN/", "/é/", "/en/" + "d/" * 300]
    rows = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/en/', '#x', '?://y'])}" for _ in range(n)]
    return [*rows, None, "", "no scheme/en/", "://", "http://", "a://b://com/", "x" * 50_000 + "://com/", "http://com/" + "y" * 50_000, "http://" + "l." * 3000 + "com/en/"]


@pytest.mark.parametrize("dealt", [False, True])
def test_rules(spark, monkeypatch, dealt):
    if dealt:
        monkeypatch.setattr(urls, "MOST_RULES", 0)
        monkeypatch.setattr("punctuality.llm.shared.HOT_ROWS", 20)
    texts = made(400)
    pages = spark.createDataFrame([(i % 390, t, "mine", 1) for i, t in enumerate(texts)], "page_id long, url string, host string, row int")
    out = urls.judge(pages.repartition(3), urls.rules_of(spark, RULES))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, out.collect())) == sorted(key((i % 390, *plain(t, RULES))) for i, t in enumerate(texts))


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (None, None)], "page_id long, url string")
    none = urls.rules_of(spark, RULES).limit(0)
    assert sorted(map(str, (tuple(r) for r in urls.judge(pages, none, default="block").collect()))) == ["(1, 'a.com', '/x', None, 'block')", "(None, '', '', None, 'block')"]
    assert urls.judge(pages.limit(0), urls.rules_of(spark, RULES)).count() == 0


def test_plan_is_built_in(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    plan = urls.judge(pages, urls.rules_of(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
