import random
import time

import numpy as np
import pytest

from quillstack.llm import html_extract as h

SCHEMA = "page_id long, url string, html string"


def text_of(spark, *pages):
    rows = [(i, "http://a.example/x", p) for i, p in enumerate(pages)]
    return [r["text"] for r in h.extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]


def test_article(spark):
    page = '<html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head><body><header>site</header><nav><ul><li>menu</li></ul></nav><!-- <p>c</p> --><div class="ad">buy</div><article><div class="post-header"><h1>H &amp; h</h1></div><p>a <b>b</b>c&nbsp; d<br>e<div class="share-box">share</div><section id="comments"><p>first!</p></section><form>f</form><p>unclosed</article><aside>side</aside><div class="cookie-notice">ok</div><footer>&copy;</footer></body></html>'
    assert text_of(spark, page) == ["H & h a bc d e unclosed"]


def test_host_repeats_on_pages_without_an_article(spark):
    menu = "<div>all news from here and there every single day</div>"
    assert text_of(spark, f"<p>one two</p>{menu}", f"{menu}<p>three four</p>") == ["one two", "three four"]
    assert text_of(spark, f"<p>one two</p>{menu}") == ["one two all news from here and there every single day"]


def test_edges(spark):
    rows = [(1, None, "<p>x</p>"), (2, "bad url", None), (3, "http://a/", ""), (3, "http://a/", ""), (None, "http://a/", "<p>y"), (4, "http://a/", "<article>" + "w " * 50_000), (5, "http://a/", "<div <p> </ >< &#x;&bogus; z"), (6, "http://a/", "no tags < here")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", text int")
    got = h.extract(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == "x" and by[2]["text"] == "" and by[3]["n_chars"] == 0 and by[None]["text"] == "y" and by[4]["n_chars"] == 99_999 and by[6]["text"] == "no tags < here"
    assert h.extract(df.limit(0)).count() == 0


def test_large_hosts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(h, "PAGES", 4)
    menu = "<div>all news from here and there every single day</div>"
    got = text_of(spark, *(f"<p>n{i}</p>{menu}" for i in range(40)))
    assert got == [f"n{i}" for i in range(40)]


def test_runs_by_brute_force():
    r = np.random.default_rng(2)
    for _ in range(30):
        page = np.sort(r.integers(0, 4, 60))
        tokens = r.integers(0, 2, 60)
        tokens[20:32] = tokens[40:52]
        want = np.zeros(60, bool)
        runs = [(tuple(tokens[i : i + h.RUN]), page[i], i) for i in range(60 - h.RUN + 1) if page[i] == page[i + h.RUN - 1]]
        for t, p, i in runs:
            if any(t == u and p != q for u, q, _ in runs):
                want[i : i + h.RUN] = True
        assert np.array_equal(h.repeated(tokens, page), want)


def test_runs_of_few_pages_on_a_large_host(spark, monkeypatch):
    r = np.random.default_rng(3)
    pairs = [" ".join(f"p{i}w{j}" for j in range(9)) for i in range(20)]  # each on two pages
    bodies = [f"<p>n{i}</p><div>{pairs[i % 20]}</div><div>{' '.join(map(str, r.integers(0, 3, 12)))}</div>" for i in range(40)]
    rows = [(i, f"http://a.example/{i}", b) for i, b in enumerate(bodies)] + [(7, "http://a.example/again", "<p>only this page has these eight words twice</p>")] * 2
    df = spark.createDataFrame([*rows, (None, "http://a.example/x", None), (50, "http://b.example/", bodies[0])], SCHEMA)
    whole = sorted(map(str, h.extract(df).collect()))
    monkeypatch.setattr(h, "PAGES", 4)
    assert sorted(map(str, h.extract(df).collect())) == whole
    got = text_of(spark, *(f"<p>n{i}</p><div>{pairs[i % 20]}</div>" for i in range(40)))
    assert got == [f"n{i}" for i in range(40)]


@pytest.mark.parametrize(
    "tag",
    ['section id="related-work"', 'section id="cookies"', 'div class="share-price"', "div class=search-tree", 'section class="discussion"', 'div data-class="ad"', 'div class="subscription"', "div class=\"it's\"", 'header class="header"'],
)
def test_names_of_content_delete_nothing(spark, tag):
    page = f'<body><div class="widget"><article class="post login-tutorial ad"><p>one</p><{tag}><h2>two</h2><p>three and <a href="#">a</a> link</p></{tag.split()[0]}><p>four</p></article></div></body>'
    assert text_of(spark, page) == ["one two three and a link four"]


@pytest.mark.parametrize(
    "part",
    ['<div class="ad">buy</div>', '<ul id=comments><li>first', '<div class="shareBox">x</div>', '<section class="comment-list">x</section>', '<div class="related"><a href=x>more of it</a> <a>and more</a></div>', '<div class="discussion"><div class="c">I</div><div class="c">you</div></div>', '<div id="reactions"><p>say</p><form>f</form></div>', '<div role="alert">no</div>', '<div class="newsletter">join <input> </div>', "<nav>n</nav>", '<aside class="x">a</aside>', '<textarea>t</textarea>', '<ol id="responses"><article>a</article><article>b</article></ol>'],
)
def test_furniture_inside_an_article_goes(spark, part):
    close = "</ul>" if part.startswith("<ul") else ""
    assert text_of(spark, f"<article><p>one</p>{part}{close}<p>two</p></article>") == ["one two"]


def test_the_host_decides_what_is_in_doubt(spark):
    alert = '<div class="alert">this site moves to a new address on the first of may</div>'
    pages = [f"<article><p>body {i}</p>{alert}<p>end</p></article>" for i in range(2)]
    assert text_of(spark, *pages) == ["body 0 end", "body 1 end"]
    assert text_of(spark, pages[0]) == ["body 0 this site moves to a new address on the first of may end"]
    same = "<p>a passage that both of these articles quote in full length</p>"
    assert text_of(spark, *(f"<article><p>body {i}</p>{same}</article>" for i in range(2)))[1] == "body 1 a passage that both of these articles quote in full length"


@pytest.mark.parametrize("text", ["<script ", "<a ", "<!--", "<p title=\"", "<p x='", "<div>", "</div>", "<div class=", "<script>", "<svg>", "<", "&#", "<p <p ", "<section></div>", 'class="', "<div class='ad", "<ul><li>"])
def test_broken_pages_take_time_in_proportion(text):
    page = "<article>start " + text * (1_000_000 // len(text))
    at = time.process_time()
    h.parsed(page)
    assert time.process_time() - at < 8  # a square would take hours


def test_quotes_and_ends_of_tags():
    text = lambda page: " ".join(t for t, *_ in h.blocks(page)[0])
    assert text("<p data-x=it's>don't stop</p> <p>it's</p>") == "don't stop it's"
    assert text("<p title=\"a > b\" class='c > d'>x</p>") == "x"
    assert text('<p "odd>y</p>') == "y" and text("1 < 2 <b>and</b> 3 > 2") == "1 < 2 and 3 > 2"
    assert text("a <b and no end") == "a <b and no end" and text("<p>a</p x") == "a</p x"
    assert text("<SCRIPT>no</Script >yes<style>p</style><title>t</title>") == "yes" and text("<script/>no</script>yes") == "yes" and text("a<!-- <p> -->b<!doctype x>c<?php y?>d<!---->e") == "abcde"


def tree(r, depth, inside):
    """(html, its main text if it is inside an article): an invented element and what must come out."""
    words = lambda: " ".join(r.choice(["alpha", "b&amp;b", "<b>bold</b>x", "c&#233;", "<i>i</i> j", "k<!-- c -->l"]) for _ in range(r.randint(1, 4)))
    plain = lambda t: t.replace("<b>", "").replace("</b>", "").replace("<i>", "").replace("</i>", "").replace("&amp;", "&").replace("&#233;", "é").replace("<!-- c -->", "")
    if depth == 0 or r.random() < 0.3:
        t = words()
        return f"<p>{t}" + r.choice(["</p>", ""]) + ("" if r.random() < 0.5 else "\n"), [plain(t)]
    kids = [tree(r, depth - 1, inside) for _ in range(r.randint(0, 3))]
    body, texts = "".join(k[0] for k in kids), [t for k in kids for t in k[1]]
    kind, name, gone = r.choice([("div", "", 0), ("section", ' class="story-text x"', 0), ("ul", "", 0), ("blockquote", " id=part-2", 0), ("header", "", 0), ("DIV", ' class="Ad"', 1), ("nav", "", 1), ("aside", " x", 1), ("form", "", 1), ("section", " id='comments'", 1), ("div", ' role="navigation"', 1), ("footer", "", 1), ("div", ' class="big cookie-banner"', 1)])
    return f"<{kind}{name}>{body}</{kind}>", [] if gone else texts


def test_articles_by_brute_force(spark):
    r = random.Random(9)
    pages, want = [], []
    for _ in range(300):
        kids = [tree(r, 3, True) for _ in range(r.randint(0, 4))]
        pages.append(f"<html><head><title>t</title></head><body><header>h</header>{tree(r, 2, False)[0]}<article>{''.join(k[0] for k in kids)}</article>{tree(r, 2, False)[0]}</body></html>")
        want.append(" ".join(t for k in kids for t in k[1]))
    got = text_of(spark, *pages)
    assert [g for g, w in zip(got, want) if w] == [w for w in want if w]


def test_pages_without_articles_by_brute_force(spark):
    """Blocks of a host's pages: of each the runs that no other page has."""
    r = random.Random(10)
    pool = [" ".join(f"s{i}w{j}" for j in range(r.randint(3, 14))) for i in range(25)]
    chosen = [[r.choice(pool) for _ in range(r.randint(0, 6))] + [f"own{i} " + " ".join(r.choice("ab") for _ in range(12))] for i in range(60)]
    pages = ["".join(f"<div>{b}</div>" for b in own) for own in chosen]
    words = [[w for b in own for w in b.split()] for own in chosen]
    where = {}
    for i, w in enumerate(words):
        for k in range(len(w) - h.RUN + 1):
            where.setdefault(tuple(w[k : k + h.RUN]), set()).add(i)
    want = []
    for w in words:
        hit = [False] * len(w)
        for k in range(len(w) - h.RUN + 1):
            if len(where[tuple(w[k : k + h.RUN])]) > 1:
                hit[k : k + h.RUN] = [True] * h.RUN
        want.append(" ".join(x for x, c in zip(w, hit) if not c))
    assert text_of(spark, *pages) == want
