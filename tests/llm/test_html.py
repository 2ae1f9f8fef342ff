import os
import time
from html.parser import HTMLParser

import pytest

from attestor.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="home"><header class="site">Site</header>
<div class="menu"><a href=x>Home</a></div><div id="wrap"><div class="post-content"><h2>Hello &amp; bye</h2><p>First   para
text&#33;<p>Second <b>bold</b>para<br>here<!-- c --><ul><li>one<li>two</ul><div class="share">Share</div><script>x="<p>no</p>"</script></div>
<div class="sidebar">side</div></div><section id="comments"><p>Nice post! A very long comment that would win by its length alone, again and again and again.</p></section>
<form>Name <input></form><div class="cookieNotice">We use cookies</div><footer>&copy;</footer></body></html>"""


def test_main_text_of_a_page():
    assert H.best_path(PAGE)[0] == "/html/body.home/div/div.content.post"
    assert H.extract(PAGE, None) == "Hello & bye First para text! Second boldpara here one two"


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("just text &lt;b&gt;", "just text <b>"),
        ("<article><p>a</p><nav>x</nav><p>b", "a b"),
        ("<body><article><h1>T</h1><p>a<b>b<p>c</article><footer>f</footer>", "T ab c"),
        ("<p>open <!-- never closed", "open"),
        ("<body><div>x < y</div></body>", "x < y"),
        ("<main><table><tr><td>a<td>b</table></main>", "a b"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ],
)
def test_odd_pages(page, text):
    assert H.extract(page, H.best_path(page)[0]) == text


def test_hosts_agree(spark):
    def page(k, noise=""):
        return f"<body><div class='promo2'>{'buy ' * 3}</div><div class='body{k}'><p>text {k} of the story, with enough words in it</p>{noise}</div></body>"

    long_aside = "<div class='deals'><p>" + "cheap things " * 30 + "</p></div>"
    rows = [(k, f"http://User@Host.Example:80/p/{k}", page(k), "z") for k in range(6)]
    rows += [(6, "http://host.example/p/6", f"<body><div class='body6'><p>short story</p></div>{long_aside}</body>", "z")]
    rows += [(7, None, None, "z"), (8, "nohost", "", "z"), (None, "http://a/", "<p>x</p>", "z"), (5, rows[5][1], rows[5][2], "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = H.main_text(df).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r for r in found}
    assert by[3].text == "text 3 of the story, with enough words in it"
    assert by[6].text == "short story"  # its own best container would be the deals
    assert (by[7].text, by[8].text, by[8].n_chars, by[None].text) == ("", "", 0, "x")
    assert H.main_text(df.where("false")).count() == 0


class Article(HTMLParser):
    """The text of the article elements, by the standard library's parser: blocks joined by one space."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if self.inside and tag in ("p", "h1", "br", "article"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1"):
            self.parts.append("\n")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_whole_table_equals_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    expected = {}
    for r in pages.collect():
        parser = Article()
        parser.feed(r.html or "")
        parser.close()
        expected[r.page_id] = " ".join("".join(parser.parts).split())
    found = H.main_text(pages).collect()
    assert {r.page_id: r.text for r in found} == expected and sum(map(bool, expected.values())) > 100
    assert all(r.n_chars == len(r.text) for r in found)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><article><p>One.<p><a href=x title=it's>Two</a> there.<p>Three.</article></body>", "One. Two there. Three."),
        ('<article><p>a<p class="x>b<p>c</article>', "a b c"),
        ("<article><p data-x='1' data-y=a/b>a</p><img src=x.png alt=\"<p>no</p>\"><p>b</p></article>", "a b"),
        ("<body><article><div class='sharing-economy'><p>kept</p></div><div class='post-header'>Head</div><div class='share-buttons'>no</div><div class='post-comments'>no</div></article></body>", "kept Head"),
        ("<body><div id=headerWrap>no</div><div class='entry'><p>yes, all of it</p><svg><path d='M0'><p>after</div></body>", "yes, all of it"),
        ("<article><p>x<script>var a='</p>';", "x"),
    ],
)
def test_markup_of_the_wild(page, text):
    assert H.extract(page, None) == text


@pytest.mark.parametrize("piece", ["<a ", '<a href="', "<p title=it's>x</p>", "<svg>", "<a =", " =", "<", "</", "<!", "<![CDATA[", "<!--", "<div>", "<p>", "<a b='"])
def test_long_pages_take_linear_time(piece):
    def seconds(n):
        start = time.process_time()
        H.extract("<body>" + piece * (n // len(piece)) + '"', None)
        return time.process_time() - start

    seconds(100_000)
    assert seconds(2_000_000) < 40 * max(seconds(200_000), 0.02)


def test_deep_containers_keep_their_own_path():
    page = "<div class=a>" * 20 + "one" + "</div>" * 20 + "<div class=b>" + "<div class=a>" * 19 + "two" + "</div>" * 20
    nodes, _ = H.parse(page)
    assert len({n.path for n in nodes}) == len(nodes) == 40
