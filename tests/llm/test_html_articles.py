"""What stands inside an article stays: names that only sound like furniture, headings that pages share, several articles, labels."""

import pytest

from tidemark.llm import html


def extracted(spark, pages, host="h.org"):
    df = spark.createDataFrame([(k, f"http://{host}/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text.split("\n") for r in html.extract(df).collect()}


ARTICLE = """<html><body><nav><a href=/>Home</a></nav><article><h1>Title {k}</h1><p>First words of text {k}.</p>
<section id="related-work"><h2>Related work</h2><p>Others did this {k}.</p></section><p class="notice-period">The notice is {k} days.</p>
<ul class="menu-of-the-day"><li>Soup {k}</li></ul><table class="widget-specs"><tr><td>Weight {k} kg</td></tr></table><p><label>Marked {k}</label></p>
<div class="related-posts"><a href=/a>Other one</a></div><div class="share-buttons">Share this</div><div class="comment-list"><p>A reader says {k}</p></div>
<div class="toc-topics"><a href="#a">Jump to part one of it</a><a href="#b">Jump to part two</a></div><div id="cookie-banner-2">Cookies!</div>
</article><footer>Small print</footer></body></html>"""


@pytest.mark.parametrize("n", [1, 6])
def test_names_that_sound_like_furniture(spark, n):
    got = extracted(spark, [ARTICLE.format(k=k) for k in range(n)])
    for k in range(n):
        assert got[k] == [f"Title {k}", f"First words of text {k}.", "Related work", f"Others did this {k}.", f"The notice is {k} days.", f"Soup {k}", f"Weight {k} kg", f"Marked {k}"]


def test_shared_headings_of_unmarked_articles_stay(spark):
    page = "<html><body><div class=x1>Our site of news</div><div class=q7><h2>Abstract</h2><p>Text of page {k} is here and goes on {k} times.</p><h3>Results</h3><p>What came of it on page {k}.</p><p>Read on the next page</p></div><div class=z>All rights reserved</div></body></html>"
    got = extracted(spark, [page.format(k=k) for k in range(6)])
    assert all(got[k] == ["Abstract", f"Text of page {k} is here and goes on {k} times.", "Results", f"What came of it on page {k}."] for k in range(6))


def test_short_articles_beside_long_ones_stay_and_teasers_go(spark):
    page = "<html><body><main><article><p>" + "long text {k} " * 60 + "</p></article><article><p>Update {k}: short.</p></article><article><a href=/x>Another story that is told elsewhere {k}</a></article></main></body></html>"
    got = extracted(spark, [page.format(k=k) for k in range(5)])
    assert all(len(got[k]) == 2 and got[k][1] == f"Update {k}: short." for k in range(5))


@pytest.mark.parametrize(
    "name, furniture",
    [("related-posts", True), ("post-related", True), ("sidebar", True), ("ad-slot-1", True), ("site-footer", True), ("comments_area", True), ("related-work", False), ("notice-period", False), ("widget-specs", False), ("menu-of-the-day", False), ("post-body", False), ("content", False)],
)
def test_names_of_furniture(name, furniture):
    assert html.names_furniture(name) == furniture


def test_a_very_long_page(spark):
    page = "<html><body><article>" + "".join(f"<p>Line {k} of it.</p>" for k in range(60_000)) + "</article></body></html>"
    got = extracted(spark, [page, "", None])
    assert len(got[0]) == 60_000 and got[0][-1] == "Line 59999 of it." and got[1] == got[2] == [""]
