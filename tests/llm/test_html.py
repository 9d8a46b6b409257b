import re
from html import unescape

from colloquy.llm.html import extract, main_text


def test_pages_give_their_articles(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r for r in extract(pages).collect()}
    assert set(got) == set(html)
    for i, page in html.items():
        article = re.sub("</?b>", "", re.search("<article>(.*)</article>", page, re.S).group(1).replace("<br>", " "))
        parts = [re.sub(r"\s+", " ", unescape(p)).strip() for p in re.split("</?(?:p|h1)>", article)]
        assert got[i].text == "\n".join(p for p in parts if p)
        assert got[i].n_chars == len(got[i].text)


def test_what_is_cut_away():
    body = "<p>One, two. Three words here, and more of them.</p><p>Short.</p>"
    around = [
        "<nav>a, b. c, d. e</nav>", "<header><p>Site, name. Here</p></header>", "<footer>&copy; x, y. z</footer>", "<aside>side, bar. text</aside>", "<form>mail, name. <button>go</button></form>",
        "<div class='cookie-notice'>We use, cookies. Yes, we do.</div>", "<div id=sidebar>x, y. z, a.</div>", "<section class=\"comments\"><p>I like, this. A lot, really, a lot.</p></section>",
        "<div class=\"ad-slot\">Buy, now. Cheap, very.</div>", "<script>var a = '</p>. , . ,';</script>", "<style>p{a:b}</style>", "<div role='navigation'>a, b. c</div>", "<div style='display: none'>a, b. c</div>", "<!-- a, b. c -->",
    ]
    for extra in around:
        for page in (f"<html><body>{extra}<div class=content>{body}</div></body></html>", f"<body><main>{body}{extra}</main></body>", f"<article>{extra}{body}</article>"):
            assert main_text(page) == "One, two. Three words here, and more of them.\nShort.", page


def test_names_of_wrappers_cut_nothing():
    body = "<p>One, two. Three words here, and more of them.</p><p>Short.</p>"
    want = "One, two. Three words here, and more of them.\nShort."
    for name in ("content no-sidebar", "layout has-sidebar", "topic social-science", "search-results-page", "legal", "print", "popular"):
        for side in ("", "<div class='sidebar'>x, y. z</div>", "<div class='page-footer'>x, y. z</div>"):
            assert main_text(f"<body><div class='{name}'>{body}</div>{side}</body>") == want, name
    assert main_text("<body><p class='legal'>One, two. Three, four.</p><p class='legal'>Five, six. Seven.</p></body>") == "One, two. Three, four.\nFive, six. Seven."
    assert main_text("<body><span class='search'>One, two. Three.</span></body>") == "One, two. Three."


def test_tolerance():
    assert main_text("<p>a <b>b<p>c &amp; d&eacute; &#x41; &lt;e") == "a b\nc & dé A <e"
    assert main_text("1 < 2, really. <p>x > y, too.") == "1 < 2, really.\nx > y, too."
    assert main_text("plain\n\n  text") == "plain text"
    assert main_text("<p title=\"a > b\">x, y.</p>") == "x, y."
    assert main_text(None) == main_text("") == main_text("<html><head><title>t</title></head></html>") == main_text("<script>x") == ""
    assert main_text("<div>" * 3_000 + "deep, text.") == "deep, text."
    assert len(main_text("<p>" + "word, " * 50_000)) == 299_999


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>é, x.</p>", None)], "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract(pages).collect())
    assert got == [(0, "", "é, x.", 5), (1, "u", "", 0), (1, "u", "", 0)]
    assert extract(pages.limit(0)).count() == 0
