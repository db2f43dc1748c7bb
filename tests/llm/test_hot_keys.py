"""Hot keys, bounds of broadcasts and odd inputs of operators 4 and 9."""

import random

import pytest
from pyspark.sql import functions as F

from codexa.llm import common, decontaminate, url_filter

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "a.b.example.org", ""), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "com", "/fr/"), ("block", "", "/x"), (None, "com", "/"), ("block", "com", "/de/")]


def plain(url, default):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = rest.split("#")[0].split("?")[0].split("/")[0]
    path = rest[len(host) :].split("#")[0].split("?")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), v == "allow", h, p, v) for v, h, p in RULES if v and (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2] + best[3], best[4] if best else default


@pytest.mark.parametrize("most", [100_000, 1])
def test_urls(spark, monkeypatch, most):
    """Broadcast and salted joins give what a plain look at each rule gives; a URL of a third of the pages and further columns change nothing."""
    monkeypatch.setattr(url_filter, "MAX_LENGTHS", most)
    monkeypatch.setattr(url_filter, "MAX_RULES", most)
    rng = random.Random(1)
    hosts = ["org", "Example.ORG", "x.example.org", "a.b.example.org", "z.a.b.example.org", "com", "www.com", "wcom", "", "org.", "é.com", "." * 50 + "com", "a." * 3000 + "example.org"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/es', '/fr/a?b', '/de/#c', '?q', '/x/y'])}" for _ in range(200)]
    urls += ["http://com/de/1"] * 100 + [None, None, "no scheme", "://", "://org/"]
    pages = spark.createDataFrame([(i, u, "p", "r") for i, u in enumerate(urls)], "page_id long, url string, prefix string, rule string").repartition(3)
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules, "none").collect()}
    assert got == {i: plain(u, "none") for i, u in enumerate(urls)}
    assert url_filter.url_filter(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.url_filter(pages, rules.limit(0), "none").collect()} == {"none"}


def test_one_url_is_no_key(spark):
    """No shuffle of the pages is dealt by url, host, path or digest."""
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.lit("http://com/de/").alias("url"))
    out = url_filter.url_filter(pages, spark.createDataFrame(RULES, "verdict string, host string, path string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and all("hashpartitioning(row#" in x for x in dealt)


def test_met(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(60)] + [(None, 99)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (7, "d")], "k int, w string")
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(str, left.join(right, ["k"], how).collect()))
        for most in (100, 1):
            assert sorted(map(str, common.met(left, right, ["k"], most, ["v"], how).collect())) == want


@pytest.mark.parametrize("most", [500_000, 1])
def test_repeated_rows_and_common_words(spark, monkeypatch, most):
    """A third of the rows is one row, windows of the most common words, one item twice: each row gets what it gets alone, whatever is broadcast."""
    for name in ("MAX_TERMS", "MAX_DOCS", "MAX_CANDS"):
        monkeypatch.setattr(decontaminate, name, most)
    rng = random.Random(2)
    common_words = "to be or not to be that is the question to be or not".split()
    text = lambda n: " ".join(rng.choice(common_words) for _ in range(n))
    item = " ".join(common_words)
    texts = [f"{text(30)} {item} {text(20)}", text(60), f"Other words, {item.upper()}! And then {item}", "", None] + [text(40) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 300 + [(2, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(1, item), (2, item), (3, "to be"), (4, None), (5, " ")], "item_id long, text string")
    got = {(r.doc_id, r.th): (r.n_hit, tuple(r.ids or ())) for r in decontaminate.contamination(docs, bench).collect()}
    hashed = {(r.doc_id, r.th): r.text for r in docs.select("doc_id", F.xxhash64("text").alias("th"), "text").distinct().collect()}

    def brute(t):
        w = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        hit, ids = set(), set()
        for i, x in ((1, common_words), (2, common_words), (3, ["to", "be"])):
            n = min(len(x), 10)
            windows = {tuple(x[s : s + n]) for s in range(len(x) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    ids.add(str(i))
        return len(hit), tuple(sorted(ids))

    for key, t in hashed.items():
        n, ids = brute(t)
        assert (got.get(key) or (0, ())) == (n, ids) or (not n and not (got.get(key) or (None,))[0])
    hits = decontaminate.hits_of(docs, decontaminate.anchors_of(docs, decontaminate.items_of(bench)))
    assert hits.count() == hits.distinct().count()  # copies leave one set
