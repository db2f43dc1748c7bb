"""The style tree against a brute-force version, branches cut without any name, and pages that once hung."""

import math
import time
from collections import Counter

import pytest

from codexa.llm import page_text

SCHEMA = "page_id long, url string, html string"


def site(host, n, names=True):
    a = "article" if names else "div"
    return [(i, f"http://{host}/{i}", f"<body><div><ul><li>Home<li>About</ul></div><div>Offer {i % 2}</div><{a}><h1>Title {i}</h1>" + "".join(f"<p>Story {i} part {j}" for j in range(1 + i % 4)) + f"</{a}><div>All rights reserved</div></body>") for i in range(n)]


def test_the_tree_cuts_without_names(spark):
    rows = site("a.org", 60, names=False) + [(100 + i, f"http://b.org/{i}", "<body><div>Same</div><div>Same too</div></body>") for i in range(20)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r["page_id"]: r["text"] for r in page_text.page_text(pages, prior=False).collect()}
    assert all(got[i] == f"Title {i} " + " ".join(f"Story {i} part {j}" for j in range(1 + i % 4)) for i in range(60))
    assert all(got[100 + i] == "Same Same too" for i in range(20))  # pages that do not differ keep all
    # without the tree nothing goes
    assert page_text.extract(rows[3][2], set(), prior=False).startswith("Home About Offer 1 Title 3")


def test_importance_by_brute_force(spark):
    rows = site("a.org", 21) + site("c.org", 9)
    rows += [(90, None, None), (91, "http://a.org/x", "<div>" * 40 + "deep</div>")]
    pages = spark.createDataFrame(rows, SCHEMA)
    host = page_text.host_and_path(page_text.F.col("url"))[0]
    got = {(r["root"], r["branch"]): r["importance"] for r in page_text.style_tree(pages.select(host.alias("host"), "html")).collect()}
    hosts = {h: [page_text.Page(p, h) for _, u, p in rows if (u or "").startswith(f"http://{h}/" if h else "none") or not h and u is None] for h in ("a.org", "c.org", "")}
    behind = relations([p for mine in hosts.values() for p in mine])
    want = {}
    for mine in hosts.values():
        for b, (n, rel, _) in relations(mine).items():
            m, all_rel, _ = behind[b]
            w, v = n / (n + page_text.EVIDENCE), m / (m + page_text.EVIDENCE)
            alike = relations(mine)[page_text.PAGE][2] == 0
            want[mine[0].root, b] = 1 if alike else w * rel + (1 - w) * (1 - v * (1 - all_rel))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def relations(mine):
    """Branch -> (pages, importance in relation to the page's, the page's) of the tree of some pages."""
    shapes, texts, pages_of, chars, above = {}, {}, Counter(), Counter(), {}
    for p in mine:
        for b in set(p.branch):
            pages_of[b] += 1
        for k, b in enumerate(p.branch):
            if p.depth[k] > page_text.DEPTH:
                continue
            shapes.setdefault(b, Counter())[p.shape[k]] += 1
            path, up = [], k
            while up >= 0:
                path.append(p.branch[up])
                up = p.parent[up]
            above[b] = path
        for k, t in p.texts:
            texts.setdefault(p.branch[k], Counter())[t] += 1
            chars[p.branch[k]] += len(t)

    def own(b):
        c = texts.get(b) or shapes[b]
        n = sum(c.values())
        return max(0.0, 1 - sum(v * math.log(v) for v in c.values()) / (n * math.log(n))) if n > 1 else 1.0

    mean = {}
    for a in shapes:
        parts = [(page_text.DECAY ** above[b].index(a) * (sum(shapes[b].values()) + chars[b]), own(b)) for b in shapes if a in above[b]]
        mean[a] = sum(w * x for w, x in parts) / sum(w for w, _ in parts)
    whole = mean[page_text.PAGE]
    return {b: (pages_of[b], min(1, x / whole) if whole > 0 else 1, whole) for b, x in mean.items()}


STORY = "The first part of the story. The second one, which is longer. " * 4
PARAGRAPHS = f"<h1>Title</h1><p>{STORY}</p><p>End.</p>"
WANTED = " ".join(f"Title {STORY} End.".split())
AROUND = "<nav><ul><li><a href=/>Home</a><li>About us</ul></nav><header>Site name</header>{}<aside>Also read this</aside><div class='sidebar'>Side</div><div class=cookie-banner>We use cookies</div><div id=comments><article class=comment>I agree</article></div><form><input>Sign up</form><footer>Imprint</footer>"
FRAMES = {
    "open head": f"<html><head><meta charset=utf-8><title>x</title><body>{AROUND.format('<article>' + PARAGRAPHS + '</article>')}",
    "open head, plain": f"<head><title>x</title><body>{AROUND.format(PARAGRAPHS)}",
    "text ends head": f"<head><title>x</title>Title <p>{STORY}</p><p>End.</p>",
    "form around main": f"<body><form>{AROUND.format('<main>' + PARAGRAPHS + '</main>')}</form>",
    "form around article": f"<form id=aspnet><div><article>{PARAGRAPHS}</article></div><nav>Menu</nav></form>",
    "form around paragraphs": f"<form><div>{PARAGRAPHS}</div><nav>Menu</nav></form>",
    "dialog around article": f"<div role=dialog><article>{PARAGRAPHS}</article></div><footer>x</footer>",
    "no-sidebar": f"<div class='no-sidebar'>{PARAGRAPHS}</div>",
    "body class": f"<body class='no-sidebar with-comments'>{AROUND.format('<div>' + PARAGRAPHS + '</div>')}",
    "page-with-menu": f"<div class='page-with-menu'>{PARAGRAPHS}</div><div class=menu>Home</div>",
    "widget-content": f"<div class='widget-content'>{PARAGRAPHS}</div>",
    "widget around article": f"<div class='widget'><article class='post comments-open'>{PARAGRAPHS}</article></div>",
    "header around paragraphs": f"<div class=header><div>{PARAGRAPHS}</div></div><div class=ad>Buy</div>",
    "article in aside only": f"<aside><article>{PARAGRAPHS}</article></aside><footer>x</footer>",
    "comments beside plain text": f"<div>{PARAGRAPHS}</div><ol class=comment-list><li><article class=comment>{STORY * 3}</article></ol>",
    "words inside": f"<article><h1>Title</h1><div class='related-work market-share'><p id=comment-on-theory>{STORY}</p></div><div class='related-posts'>Other</div><p>End.</p><div class='share-buttons'>Share</div></article>",
    "noise inside": f"<main><div class='ad-slot'>Buy</div>{PARAGRAPHS}<div id=disqus>Load</div><section class='reader-comments'><p>{STORY}</p></section></main>",
}


@pytest.mark.parametrize("name", FRAMES)
def test_whole_article_and_nothing_else(name):
    assert page_text.extract(FRAMES[name], set()) == WANTED


def test_names():
    for x in ("ad", "ads", "top-ad", "ad_slot", "AD1", "site-footer", "main-nav", "cookie-banner", "comments-area", "share-buttons", "post sidebar", "legal-notice", "menu__item"):
        assert page_text.names_noise(x.lower()), x
    for x in ("", "no-sidebar", "page-with-menu", "widget-content", "related-work", "market-share", "comment-on-theory", "comments-open", "entry-header", "admin", "shared", "socialism", "navigator"):
        assert not page_text.names_noise(x), x


def test_the_corpus_tree_serves_small_hosts(spark):
    """Forty hosts of two pages: no host shows what repeats, all together do. No class or id word is used."""
    rows = [(2 * h + i, f"http://h{h}.org/{i}", f"<body><div class=x7>Offers of the week, number {h % 2}</div><article><h1>T {h} {i}</h1><p>Story {h} of {i} and more {h * i}</p></article><p class=y1>All rights reserved</p></body>") for h in range(40) for i in range(2)]
    plain = [(i, u, p.replace("article>", "div>")) for i, u, p in rows]
    for pages, prior in ((rows, True), (plain, False)):
        got = {r["page_id"]: r["text"] for r in page_text.page_text(spark.createDataFrame(pages, SCHEMA), prior=prior, words=False).collect()}
        assert all(got[2 * h + i] == f"T {h} {i} Story {h} of {i} and more {h * i}" for h in range(40) for i in range(2))


def test_many_low_branches_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(page_text, "MAX_LOW", 2)
    rows = site("a.org", 40, names=False) + [(100 + i, u.replace("a.org", "b.org"), h) for i, u, h in site("a.org", 40, names=False)]
    got = {r["page_id"]: r["text"] for r in page_text.page_text(spark.createDataFrame(rows, SCHEMA), prior=False).collect()}
    assert len(got) == 80 and all(got[i].startswith(f"Title {i % 100} Story") and "reserved" not in got[i] for i in got)


@pytest.mark.parametrize("page", [
    "<div>" * 2000 + "text", "<a" * 50_000, '<a x="' * 50_000, "<p a='\"" * 50_000, "<div>" * 20_000 + "</x>" * 20_000 + "text", "<div class=menu>" * 20_000 + "<article>text",
    "<!--" * 50_000, "<" * 50_000, "<script>" * 50_000, "<p " + "= " * 50_000 + ">text", "<p><li><dt>" * 20_000 + "text", "<![CDATA[" * 50_000, "&" * 50_000, "</" * 50_000,
], ids=range(14))
def test_broken_pages_take_linear_time(page):
    began, counts = time.process_time(), Counter()
    text = page_text.extract(page, set())
    page_text.count_page(page_text.Page(page), counts)
    assert time.process_time() - began < 3 and ("text" not in page or text.endswith("text"))
    assert len(counts) < 5000


def test_markup_rules():
    x = lambda h: page_text.extract(h, set())
    assert x("<p>a<b>b</b>c<br>d<p title='x>y'>e &lt;f&gt; &amp; 3 < 4") == "abc d e <f> & 3 < 4"
    assert x("<div role=navigation>m</div><p>t</p><textarea>no</textarea><svg/>u") == "t u"
    assert x("<article>a<article class=comment>r</article></article>b") == "a"
    assert x(None) == x("") == x("<!-- never closed <p>t") == ""
