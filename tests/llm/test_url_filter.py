import random

import pytest

from quillstack.llm import queries, url_filter

SCHEMA = "page_id long, url string"
RULES = "host string, path string, verdict string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def brute(url, rules, default="allow"):
    host, path = parts(url)
    best = None
    for h, p, v in rules:
        if None in (h, p, v):
            continue
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            key = (h.count(".") + 1 if h else 0, len(p), v == "block")
            best = max(best, (key, h + p, v)) if best else (key, h + p, v)
    return (host, path, best[1], best[2]) if best else (host, path, None, default)


def got(spark, urls, rules, **how):
    rows = spark.createDataFrame(list(enumerate(urls)), SCHEMA)
    found = url_filter.filter_urls(rows, spark.createDataFrame(rules, RULES), **how)
    return [tuple(r)[2:] for r in found.orderBy("page_id").collect()]


def cases():
    r = random.Random(5)
    hosts = ["org", "a.org", "b.a.org", "com", "x.com", "", "a", ".org", "A.org", "a.org:80", "org.", "a..org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a//b", "/é", "/a/b/c/d"]
    rules = [(r.choice(hosts).lower(), r.choice(paths), r.choice(["allow", "block"])) for _ in range(40)] + [("org", "/", "allow"), ("org", "/", "block"), (None, "/", "block"), ("com", None, "block"), ("com", "/", None)]
    urls = [f"http://{r.choice(['', 'www.', 'B.', 'u@'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', 'x', '/', '?q=/a', '#/b', '://c.com/a'])}" for _ in range(400)]
    return urls + [None, "", "no scheme", "://", "http://", "://org/", "http://a.org\n/b\nc", "http://a.org/" + "a/" * 50_000, "http://" + "a." * 50_000 + "org/a"], rules


@pytest.mark.parametrize("most", [100_000, 7])
def test_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_RULES", most)
    urls, rules = cases()
    assert got(spark, urls, rules) == [brute(u, rules) for u in urls]


def test_no_rules_and_no_rows(spark):
    assert got(spark, ["http://a.org/x"], [], default="block") == [("a.org", "/x", None, "block")]
    assert got(spark, [], [("org", "/", "allow")]) == []


def test_repeated_rows_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "http://org/", 7, "h", "v"), (1, "http://org/", 7, "h", "v")], SCHEMA + ", extra int, Host string, verdict string")
    found = url_filter.filter_urls(rows, spark.createDataFrame([("org", "/", "block")], RULES)).collect()
    assert [r.asDict() for r in found] == [{"page_id": 1, "url": "http://org/", "extra": 7, "host": "org", "path": "/", "rule": "org/", "verdict": "block"}] * 2


def test_query_by_brute_force(spark, tmp_path):
    urls = ["http://a.EXAMPLE.org/es/1", "http://example.org/es", "http://example.org/en/12?x", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/#", "http://x.com/it/", "http://org", None]
    spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], SCHEMA + ", html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.QUERIES["op12_url_filter"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in found] == [brute(u, queries.URL_RULES) for u in urls]
    assert [r["rule"] for r in found] == ["example.org/es/", "org/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None]
