import pytest

from barloom.llm.templates import blocks, deduce_templates, extract, main_texts

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a><li>More</ul></nav><!-- ad --><div class="ad">Buy</div>
<div id="cookie-notice">We use cookies</div>
<article><h1>Title &lt;one&gt;</h1><p>First <b>bold</b>
 text&nbsp;here<p>Second<br>line<div class="share">Share</div><form><input><label>Mail</label></form>
<ul><li>one<li>two</ul><blockquote>5 < 6 and a&eacute;</blockquote><section class="comments"><p>Great post!</p></section></article>
<aside>Side</aside><div class="reader-comments"><p>Nice</p></div><footer>&copy; x</footer></body></html>"""


def test_article():
    assert extract(PAGE, frozenset()).split("\n") == ["Title <one>", "First bold text here", "Second line", "one", "two", "5 < 6 and aé"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b", "a\nb"),
        ("<nav>menu<article><p>x</p></article>", "x"),
        ("<div>a<span class='ad'>no</span>b</div>", "a\nb"),
        ("<p>open <b>bold", "open bold"),
        ("<script>x", ""),
        ("<div title='a > b'>x</div>", "x"),
        ("<p>x</p><div class=\"comments\"><div>y</div>z</div>w", "x\nw"),
        ("<p>" + "word " * 50_000 + "</p>", ("word " * 50_000).strip()),
    ],
)
def test_cases(page, text):
    assert extract(page, frozenset()) == text


def site(n):
    return [(i, "http://H.example/%d" % i, f"<html><body><div class='x1'>Welcome to our site</div><div class='x2'><p>Body {i} text</p><p>Tail {i % 3}</p></div><div>Imprint</div></body></html>") for i in range(n)]


def test_template_is_taken_out(spark):
    rows = site(20) + [(100, None, "<p>alone</p>"), (101, "https://other.example/", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in main_texts(df).collect()}
    assert got[4] == "Body 4 text\nTail 1" and got[100] == "alone" and got[101] == ""
    found = {len(r.texts): r for r in deduce_templates(df).collect() if r.texts}
    assert found[2].host == "h.example" and found[2].pages == 20
    assert main_texts(df.limit(0)).count() == 0


def test_few_pages_have_no_template(spark):
    df = spark.createDataFrame(site(5), "page_id long, url string, html string")
    assert main_texts(df).where("page_id = 4").first().text == "Welcome to our site\nBody 4 text\nTail 1\nImprint"
    assert [b[0] for b in blocks(site(1)[0][2])][0] == "/html/body/div.x1"


def test_repeated_tokens_of_a_page(spark):
    rows = [(i, "http://h/", "<ul>" + "<li>same</li>" * 50 + f"</ul><p>own {i}</p>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in main_texts(df).collect()} == {f"own {i}" for i in range(12)}
