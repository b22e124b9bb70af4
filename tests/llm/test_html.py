from __future__ import annotations

from cosmolake.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p><b>One   two<br><p>Three {0}</p></article>
<div class="comments"><p>first!</p></div><aside>side</aside><form>f</form><footer>&copy; x</footer></body></html>"""


def test_article_without_what_is_around_it():
    page = PAGE.format("four")
    path = html_text.paths(page)[0][0]
    assert path == "/html/body/article"
    assert html_text.extract(page, path) == "Title & more\nOne two\nThree four"
    assert html_text.extract(page, "/no/such/path") == "Title & more\nOne two\nThree four"


def test_pages_that_stop_anywhere():
    page = PAGE.format("four")
    for k in range(0, len(page), 7):
        html_text.extract(page[:k], "/html/body/article")
        html_text.paths(page[:k])


def test_odd_markup():
    assert html_text.extract("", None) == ""
    assert html_text.extract("just text", None) == "just text"
    assert html_text.extract("<div>a<ul><li>b<li>c</ul></div>", None) == "a\nb\nc"
    assert html_text.extract("<article><p>a < b &lt; c&#33;</p></article>", None) == "a < b < c!"
    for s in ("<" * 50_000, "<div>" * 20_000 + "x", "&amp;" * 20_000, "<!--" * 20_000, "<p>" * 20_000):
        html_text.extract(s, None)


def test_host_consensus_and_edge_cases(spark):
    right = [(k, f"http://www.h.org/{k}", f'<body><div class="c{k}"><div class="main{k}"><p>' + "word " * 60 + f"{k}</p></div><p>foot</p></div></body>") for k in range(5)]
    # On its own this page would choose the outer block; its host's path picks the inner one.
    odd = (9, "http://h.org/9", '<body><div class="c9"><div class="main9"><p>short</p></div><p>' + "teaser " * 40 + "</p></div></body>")
    rows = [*right, odd, odd, (10, None, None), (11, "not a url", ""), (None, "http://x.org", "<p>x</p>")]
    df = spark.createDataFrame([(*r, "t", "p") for r in rows], "page_id long, url string, html string, path string, host string")
    got = html_text.main_text(df).select("page_id", "text").collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert texts[9] == "short" and texts[10] == "" and texts[11] == "" and texts[None] == "x"
    assert texts[3].endswith("word 3")


def test_empty_table(spark):
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_all_of_an_article_made_of_sections():
    long = "word " * 60
    page = f"<body><nav>Menu</nav><article><h1>Title</h1><p>Intro</p><section><p>{long}</p></section><section class=b><p>{long}</p></section><div class=body><p>End</p></div></article><div class=x>Other</div></body>"
    path = html_text.paths(page)[0][0]
    want = "\n".join(["Title", "Intro", long.strip(), long.strip(), "End"])
    assert html_text.extract(page, path) == html_text.extract(page, "/body/article/section") == html_text.extract(page, None) == want


def text_of(body):
    return html_text.extract(f"<html><body><nav>n</nav>{body}</body></html>", None)


def test_attributes_as_the_standard_reads_them():
    assert text_of("<article><p title=don't>Hello there</p></article>") == "Hello there"
    assert text_of("<article><p a='>' b=\">\" c=x>y</p><p a = b / c>z</p></article>") == "y\nz"
    assert text_of('<article><p =x class="a"class=ad>kept</p></article>') == "kept"
    for s in ("<p a=" * 30_000, "<p '" * 30_000, "<p " + "a=b " * 60_000, "<p a=\"" * 30_000, "</p " + "=" * 100_000):
        html_text.extract(s, None)


def test_parts_of_an_article_stay():
    for part in ("<div class='discussion'><p>x</p></div>", "<section id='related-work'><p>x</p></section>", "<p class='print'>x</p>", "<p class='ad-hoc'>x</p>", "<noscript><p>x</p></noscript>", "<object>x</object>", "<p><math><mi>x</mi></math></p>"):
        assert text_of(f"<article><p>start</p>{part}</article>") == "start\nx", part
    for part in ("<div class='ad'>x</div>", "<div class='comment-list'>x</div>", "<div id=comments>x</div>", "<aside>x</aside>", "<form>x</form>", "<div class='cookie-notice box'>x</div>", "<ul class='share-buttons'><li>x</ul>", "<style>x</style>", "<footer>x</footer>", "<nav>x</nav>"):
        assert text_of(f"<article><p>start</p>{part}</article>") == "start", part


def test_every_depth_and_class_has_its_path():
    deep = "<div class=d>" * 300
    _, containers = html_text.scan(f"{deep}<div class='a b c d e'>x</div><div class='a b c d f'>y")
    assert len({c.path for c in containers}) == 302 and max(len(c.path) for c in containers) <= html_text.LONG + 20
    page = "<body>" + "".join(f"<div class=k{c}><p>{'w ' * 20}</p></div>" for c in "abcdefgh")
    assert len(html_text.paths(page)) >= 8


def slow(page):
    """The article's text by the standard library's parser."""
    import re
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.off, self.inside, self.out = 0, 0, [[]]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.off += tag in ("nav", "aside", "footer", "form", "script", "style")
            self.out.append([]) if tag in html_text.BLOCK else self.out[-1].append(" " if tag == "br" else "")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.off -= tag in ("nav", "aside", "footer", "form", "script", "style")
            if tag in html_text.BLOCK:
                self.out.append([])

        def handle_data(self, data):
            if self.inside > 0 and self.off <= 0:
                self.out[-1].append(data)

    p = P()
    p.feed(page or "")
    p.close()
    return "\n".join(x for x in (re.sub(r"\s+", " ", "".join(b)).strip() for b in p.out) if x)


def test_whole_table_equals_a_slow_extraction(spark):
    from cosmolake.llm import op2_host_paths

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = op2_host_paths.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages) and all(r["text"] == slow(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://h.org/1", "<p>x</p>", "a", "b", "c", "d")], "page_id long, url string, html string, _host string, _path string, _h string, _won string")
    r = html_text.main_text(df).collect()[0]
    assert (r["text"], r["_host"], r["_path"], r["_h"], r["_won"]) == ("x", "a", "b", "c", "d")
