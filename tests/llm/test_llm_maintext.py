import html
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from tabsight.llm import maintext, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, host string, part string, text string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_markup_tells_main_from_furniture():
    page = """<!DOCTYPE html><html><head><title>t &lt;p&gt;</title><style>p{}</style><script>var a = "</p><p>x";</script></head>
    <body class="page-with-sidebar"><header><h1>Site</h1><nav><ul><li>Home<li>News</ul></nav></header><div class="cookie-notice">We use cookies</div>
    <form><label>Search</label><input></form><div id="main-content"><div class="ad">Buy <b>now</b></div><article><header><h1>Title &amp; more</h1></header>
    <p>One  two<br>three &lt;b&gt; a &#8211; b&nbsp;c &am <!-- hidden --><p><b>Four</b>fi<em>ve</em>. 2 < 3 <span class="ad">Sponsored</span> six
    <table><tr><td>cell a<td>cell b</table><blockquote>quoted</blockquote><ul><li>x<li>y</ul><aside>Also read</aside><div hidden>no</div>
    <textarea>typed</textarea><div class="share-buttons">Share</div><section id="comments"><article><p>First!</p></article></section></article>
    <div class="related">More</div></div><footer>&copy; site</footer></body></html>"""
    parts = ["Title & more", "One two three <b> a – b c &am", "Fourfive. 2 < 3", "six", "cell a", "cell b", "quoted", "x", "y"]
    assert maintext.main_texts([page]) == ["\n\n".join(parts)]


def test_odd_markup():
    cases = {
        "": "", "   ": "", "plain text": "plain text", "<p>a": "a", "<article><p>a": "a", "a<!-- b": "a", "<p>a</p></div></p>b": "a\n\nb", "<p title='x>y'>a": "a",
        "<p title=\"x>a</p><p>b": "a\n\nb", "<script>a": "", "<article>a<script>b</SCRIPT >c": "ac", "<div><nav>m</nav>x</div>": "x", "a &amp b &unknown; &#65;": "a & b &unknown; A",
        "<article></article><p>out</p>": "out", "<main>m<p>n</main>o": "m\n\nn", "<div role=main>r</div>s": "r", "<div class=ArticleBody>r</div>s": "r", "< p>a": "< p>a", "<nav>only": "",
    }
    assert {c: maintext.main_texts([c])[0] for c in cases} == cases


def test_unmarked_boilerplate_is_found_by_repetition(spark):
    rng = random.Random(1)
    menu, foot, notice = words(rng, 12), words(rng, 15), words(rng, 10)
    rows, want = [], {}
    for k in range(12):
        body = [words(rng, 30), words(rng, 3), words(rng, 20)]
        if k in (4, 5):
            body[1:1] = ["a passage that only two pages of this host have in common with each other"]
        rows.append((k, f"https://Example.com:443/{k}", f"<div>{menu}</div><div><h2>{body[0]}</h2>" + "".join(f"<p>{b}</p>" for b in body[1:]) + f"</div><div>{foot}</div><div>{notice}"))
        want[k] = "\n\n".join(body)
    rows += [(20, "https://other.org/", rows[0][2]), (21, None, rows[0][2]), (22, None, rows[1][2]), (23, "/relative", rows[2][2])]
    got = {r.page_id: r.text for r in maintext.extract(pages_of(spark, rows)).collect()}
    assert {k: got[k] for k in want} == want
    assert menu in got[20] and foot in got[21]  # nothing to compare with


def test_notices_within_articles_and_copies():
    rng = random.Random(2)
    notice, shared = words(rng, 12), words(rng, 200)
    pages = [f"<article><p>{words(rng, 90)}</p><p>{notice}</p></article>" for _ in range(20)]
    copies = [f"<article><p>{shared}</p><p>{words(rng, 5)}</p><p>{notice}</p></article>" for _ in range(20)]
    texts = maintext.main_texts(pages + copies + copies)
    assert not any(notice in t for t in texts[:20]) and all(shared in t for t in texts[20:])
    assert all(notice in t for t in maintext.main_texts(pages[:5]))  # too few pages to tell
    same = maintext.main_texts(["<div>one two three four five six seven eight nine ten</div>"] * 30)
    assert set(same) == {"one two three four five six seven eight nine ten"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=5), st.integers(1, 6))
def test_page_counts_equal_brute_force(pages, length):
    stream = np.array([t for k, p in enumerate(pages) for t in [*p, -1 - k]])
    owner = np.array([k for k, p in enumerate(pages) for _ in range(len(p) + 1)])
    got = maintext.page_counts(stream, owner, length).tolist()
    grams = [{tuple(p[i : i + length]) for i in range(len(p) - length + 1)} for p in pages]
    want = [sum(tuple(p[i : i + length]) in g for g in grams) if i + length <= len(p) else 0 for p in pages for i in range(len(p) + 1)]
    assert got == want


def test_hot_host_is_split(spark, monkeypatch):
    monkeypatch.setattr(maintext, "GROUP_PAGES", 10)
    rng = random.Random(3)
    menu = words(rng, 20)
    rows = [(k, "http://hot.example/x", f"<div>{menu}</div><p>{words(rng, 20)}</p>") for k in range(60)]
    got = maintext.extract(pages_of(spark, rows))
    assert got.count() == 60 and not got.where(f"text like '%{menu}%'").count()
    monkeypatch.setattr(maintext, "HOT_HOSTS", 0)
    assert sorted(maintext.extract(pages_of(spark, rows)).collect()) == sorted(got.collect())


def test_split_host_is_judged_by_all_of_its_pages(spark, monkeypatch):
    """Lines on just a quarter of the streams (half in articles) go, those on one fewer stay, wherever the parts are cut."""
    rng = random.Random(4)
    lines = [(words(rng, 12), k, n) for k, n in enumerate((13, 14, 15, 16, 29, 30, 31))]
    htmls = []
    for article in (False, True):
        for k in range(30):
            body = "".join(f"<p>{line}</p>" for line, at, n in lines if (k * 7 + at * 5) % 30 < n // (1 if n > 28 else 2))
            own = "".join(f"<p>{words(rng, 90)}</p>" for _ in range(3))
            htmls.append(f"<article>{body}{own}</article>" if article else f"<div>{body}{own}</div>")
    htmls += [htmls[0].replace("<div>", "<div >")] * 20  # the same stream
    want = maintext.main_texts(htmls)
    assert any(line in want[k] for line, _, _ in lines for k in range(60)) and any(line in htmls[k] and line not in want[k] for line, _, _ in lines for k in range(60))
    rows = [(k, f"http://hot.example/{k}", h) for k, h in enumerate(htmls)] + [(100 + k, "http://small.example/", h) for k, h in enumerate(htmls[:5])]
    monkeypatch.setattr(maintext, "GROUP_PAGES", 8)
    got = {r.page_id: r.text for r in maintext.extract(pages_of(spark, rows)).collect()}
    assert [got[k] for k in range(len(htmls))] == want
    assert [got[100 + k] for k in range(5)] == maintext.main_texts(htmls[:5])


def test_registered_query_gives_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op11_host_suffix_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_awkward_tables(spark):
    rows = [(1, "http://a.b/", None), (1, "http://a.b/", None), (None, "http://a.b/", ""), (2, None, "<p>x"), (2, "http://a.b/", "<p>" + "y " * 50_000)]
    got = maintext.extract(pages_of(spark, rows)).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, 0, 1, 99_999]
    assert maintext.extract(pages_of(spark, []).limit(0)).count() == 0
