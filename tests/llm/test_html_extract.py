import pytest

from palimpsest.llm import html_extract as H


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("  ", ""), ("just text", "just text"),
    ("<article><h1>T &amp; U</h1><p><b>One.<br><p>Two\n  three&nbsp;x</p><p>.</p></article>", "T & U\n\nOne.\n\nTwo three x\n\n."),
    ("<nav><a href='/'>Menu</a></nav><div class=\"ad\">Buy</div><article><p>Body text</p></article><footer>&copy; x</footer>", "Body text"),
    ("<ARTICLE><P>a &lt; b</P><!-- <p>no</p> --><script>var t='</p><p>x';</script><style>p{}</style></ARTICLE>", "a < b"),
    ("<article><p>one</p><aside>side</aside><div class='cookie-notice'>ok?</div><form><input>f</form><p>two</p><section id=comments><p>me too</p></section></article>", "one\n\ntwo"),
    ("<main><p title=\"a > b\">x</p></main>", "x"), ("<article><p>&am &amp end &#233; &#x1F600;</p>", "&am & end é 😀"),
    ("<div><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></div><div>" + "A long paragraph of text that is the content of the page. " * 2 + "</div><div><a href=3>More</a></div>", ("A long paragraph of text that is the content of the page. " * 2).strip()),
    ("<article><table><tr><td>a</td><td>b</td></tr></table></article>", "a\n\nb"), ("<article>one<div>two</div>three</article>", "one\n\ntwo\n\nthree"),
])
def test_pages(html, text):
    assert H.main_text(html) == text


def test_surge_and_dive():
    assert H.surges([0, 5, 0, 0, 0, 0, 7, 1, 0, 0, 0], 3) == [(1, 2), (6, 8)]
    assert H.surges([], 3) == [] and H.surges([0, 0], 3) == [] and H.surges([4], 3) == [(0, 1)]


def test_operator(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "old"), (2, None, None, None), (2, None, None, None)], "page_id long, url string, html string, text string")
    out = H.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in out.collect()) == [(1, "x", 1), (2, "", 0), (2, "", 0)]
    assert H.extract(df.limit(0)).count() == 0
    assert H.main_text("<p>" + "long text " * 200_000).count("long") == 200_000


def test_comments_in_articles_and_names_that_only_look_like_boilerplate():
    page = '<article><p>Body text</p><article class="comment"><p>reader comment</p></article><div class="social-science"><p>About society</p></div><div class="social-links">share</div><p>Let <math>x</math> be</p></article>'
    assert H.main_text(page) == "Body text\n\nAbout society\n\nLet x be"
