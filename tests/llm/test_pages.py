"""Main text: the cut against all labellings, held-out pages, broken and deep markup, odd rows."""

import itertools
import random
import time

import pytest

from lodestone.llm import html_cut, html_pages

#: Names that no page of the fit has.
OTHERS = {
    "menu": ["topnav", "main-menu", "menu-bar"], "header": ["page-header", "header-wrap"], "notice": ["cookie-consent", "notices"], "ad": ["ad-slot", "adverts", "sponsor"],
    "sidebar": ["left-sidebar", "widget-box"], "related": ["recommended-posts", "sharing"], "comments": ["comment-section", "replies", "discussion"],
    "footer": ["page-footer", "contentinfo"], "article": ["post-body", "entry", "prose", "article-content", "main-text"],
}


def test_cut_is_the_cheapest_of_all_labellings():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(1, 9)
        score = [r.uniform(-4, 4) for _ in range(n)]
        edges = [(i - 1, i, r.uniform(0, 2)) for i in range(1, n)] + [(*sorted(r.sample(range(n), 2)), r.uniform(0, 3)) for _ in range(n if n > 1 else 0)]

        def cost(keep):
            return sum(max(-s, 0) if k else max(s, 0) for s, k in zip(score, keep, strict=True)) + sum(w for a, b, w in edges if keep[a] != keep[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(html_cut.minimum_cut(score, edges)) == pytest.approx(best)


def test_cut_of_small_pages():
    w = html_cut.fitted()
    for seed in range(5000, 5200):
        blocks = html_cut.blocks_of(html_pages.labelled(seed)[0])[:11]
        score, edges = [float(x) for x in (html_cut.features(blocks) @ w).clip(-12, 12)], html_cut.ties(blocks)
        cost = lambda keep: sum(max(-s, 0) if k else max(s, 0) for s, k in zip(score, keep, strict=True)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: B023, E731
        got = html_cut.labels(blocks, w)
        if len(blocks) <= 8:
            assert cost(got) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=len(blocks)))))


@pytest.mark.parametrize(("first", "names"), [(1000, None), (2000, OTHERS)])
def test_held_out_pages(first, names):
    right = total = whole = 0
    for seed in range(first, first + 200):
        page, truth = html_pages.labelled(seed, names)
        blocks = html_cut.blocks_of(page)
        assert {b.text for b in blocks} <= set(truth)
        same = [truth[b.text] == k for b, k in zip(blocks, html_cut.labels(blocks, html_cut.fitted()), strict=True)]
        right, total, whole = right + sum(same), total + len(same), whole + all(same)
    assert right / total >= 0.99 and whole >= 180


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article class="post with-sidebar menu-open nav-fixed"><p>A text that is long enough to be an article.</p></article>', "A text that is long enough to be an article."),
        ('<div class="article-header"><h1>The title</h1></div><div class="story"><p>Some text of the story, which goes on.</p></div>', "The title\nSome text of the story, which goes on."),
        ('<p class="x>First paragraph of a page with a stray quote.</p><p>And the second "one" here.</p>', 'First paragraph of a page with a stray quote.\nAnd the second "one" here.'),
        ('<article><p title="a > b">Text with a bracket in a value.</p></article>', "Text with a bracket in a value."),
        ("<article><h1>Short</h1><p>Be. Erin.<p><b>Open &amp; never closed<br>next&nbsp;line", "Short\nBe. Erin.\nOpen & never closed next line"),
        ("<article><p>kept text of some length, as one would say</p><div hidden><p>secret of a hidden part</p></div></article>", "kept text of some length, as one would say"),
        ("<main><ul><li>one item of the list<li>another item of it</ul></main><nav><a href=x>Home</a></nav>", "one item of the list\nanother item of it"),
        ("", ""), ("<!-- only", ""), ("plain < text & more", "plain < text & more"),
    ],
)
def test_markup(page, text):
    assert html_cut.main_text(page) == text


@pytest.mark.parametrize("page", ["<b>" * 30000 + "x", "<div>" * 20000 + "a", "<div>a" * 8000, "<p>" + "<b>a " * 10000 + "<p>" * 10000, "</x>" * 20000 + "<div>" * 9000 + "</y>" * 20000, "<p>a<li>b" * 6000, '<a "' * 30000, "<p>word " * 20000])
def test_time_follows_length(page):
    began = time.perf_counter()
    html_cut.main_text(page)
    assert time.perf_counter() - began < 5


def test_odd_pages(spark):
    page = "<article><p>The text of this page is long enough.</p></article>"
    rows = [(1, "u", page, "c", 5), (1, "u", page, "c", 5), (None, None, page, "c", 5), (2, "v", None, "c", 5), (3, "w", "", "c", 5), (4, "x", "<article>" + "<p>One more paragraph of it.</p>" * 20000 + "</article>", "c", 5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, __html int")
    got = sorted(((r.page_id or 0, r.url or "", r.n_chars, r.text[:20]) for r in html_cut.extract(df).collect()))
    assert got == [(0, "", 37, "The text of this pag"), (1, "u", 37, "The text of this pag"), (1, "u", 37, "The text of this pag"), (2, "v", 0, ""), (3, "w", 0, ""), (4, "x", 26 * 20000 - 1, "One more paragraph o")]
    assert html_cut.extract(df.limit(0)).count() == 0
