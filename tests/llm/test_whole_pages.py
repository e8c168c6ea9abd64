"""What the style tree sees: pages of any depth, and repeated text wherever it stands."""

import pytest

from rewritelab.llm import html_text


@pytest.mark.parametrize("tag", ["div", "font", "span"])
def test_deeply_nested_pages_do_not_fail_the_query(spark, tag):
    deep = f"<p>first</p>{f'<{tag}>' * 20_000}deep words"
    rows = [(0, "http://a.example.com/", deep), (1, "http://a.example.com/x", "<p>plain</p>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "first\n\ndeep words", 1: "plain"}
    assert html_text.styles(deep)


def texts(spark, pages):
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    return [r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


@pytest.mark.parametrize("n", [2, 3, 12])
def test_repeated_text_goes_at_any_depth_and_on_small_hosts(spark, n):
    wrap = lambda x: "<div>" * 12 + x + "</div>" * 12
    pages = [("http://a.example.com/", wrap(f"<div class=top>same words</div><div class=text>own words {i}</div>")) for i in range(n)]
    assert texts(spark, pages) == [f"own words {i}" for i in range(n)]


def test_copies_of_a_page_stay_whole(spark):
    page = "<div class=top>same words</div><div class=text>the copied words</div>"
    assert texts(spark, [("http://a.example.com/", page)] * 6) == ["same words\n\nthe copied words"] * 6


@pytest.mark.parametrize("tag", ["article", "main"])
def test_repeated_text_goes_inside_articles(spark, tag):
    box = "<div class=box>written by our staff, all rights with the house and its many partners</div>"
    pages = [("http://a.example.com/", f"<div>menu</div><{tag}><p>own words {i}</p>{box}</{tag}>") for i in range(12)]
    assert texts(spark, pages) == [f"own words {i}" for i in range(12)]


def test_shared_articles_stay_whole(spark):
    page = "<article><h1>title</h1><p>shared words</p><div class=box>more</div></article>"
    assert texts(spark, [("http://a.example.com/", page)] * 12) == ["title\n\nshared words\n\nmore"] * 12


def test_branches_that_look_alike_but_differ_stay(spark):
    kinds = "".join(f"<div class=k{k}>{{0}} {k}</div>" for k in range(30))
    pages = [("http://a.example.com/", f"<article><section>{kinds.format(i)}</section></article>") for i in range(6)]
    assert texts(spark, pages) == ["\n\n".join(f"{i} {k}" for k in range(30)) for i in range(6)]


@pytest.mark.parametrize("wrapper", ["page has-sidebar", "wrapper no-comments", "layout-sidebar-right", "notice-content", "sidebar"])
def test_wrappers_are_not_noise(spark, wrapper):
    page = f"<div class='{wrapper}'><article><p class=ad-hoc>ad hoc words</p><p>text</p><div class='comment-list'>no</div><div id=ad-slot-3>no</div></article></div><div class=footer-links>no</div>"
    assert texts(spark, [("http://a.example.com/", page)]) == ["ad hoc words\n\ntext"]


def test_teasers_are_no_articles_of_the_page(spark):
    page = "<div>own words</div><div class=related><article>teaser</article></div>"
    assert texts(spark, [("http://a.example.com/", page)]) == ["own words"]


def test_names():
    noise = "comments comment-list site-header cookieBanner ad ad-1 top_ad nav-links disqus_thread share-buttons related sidebar-left newsletter-signup"
    plain = "ad-hoc adhoc has-sidebar no-comments content article-body menu-planning loading shadow head commentary with-nav"
    assert all(map(html_text.word_names_noise, noise.split())) and not any(map(html_text.word_names_noise, plain.split()))


def test_templates_under_neutral_names(spark, monkeypatch):
    """Precision and recall of words, on hosts whose templates no name gives away; both ways of looking up noise."""
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    pages, want = [], []
    for h in range(3):
        top, end, box = ([word() for _ in range(12)] for _ in range(3))
        for i in range(15):
            own = [" ".join(word() for _ in range(20)) for _ in range(4)]
            pages.append((f"http://h{h}.example.com/{i}", f"<div class=x1>{' '.join(top)}</div><article><p>{own[0]}</p><p>{own[1]}</p><div class=x2><p>{' '.join(box)}</p></div><p>{own[2]}</p></article><div class=x3>{' '.join(end)}</div>"))
            want.append("\n\n".join(own[:3]))
    assert texts(spark, pages) == want
    monkeypatch.setattr(html_text, "MOST_BROADCAST", -1)
    assert texts(spark, pages) == want
