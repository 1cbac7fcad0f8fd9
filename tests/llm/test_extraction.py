"""Main text of pages."""

import html
import re
import time

from frames import SMALL
from hearthline.llm.extraction import blocks_of, extracted, host_of, host_paths, main_text, path_number
from hearthline.llm.queries import op7_main_text
from pyspark.sql import functions as F

PAGE = """<html><body><header>Site</header><div class="content-12"><form>x</form><header><h1>T&eacute;st</h1>by me</header>
<p>One <a href=x>two</a> three &lt;b&gt; four text here is long enough.<p>Second&nbsp;para with <b>bold<br>break
<ul><li>Item one text<li>Item two text</ul><div class="comments"><p>nice comment</p></div><aside>side</aside>
<script>if(a<b)"</div>"</script><div style="display: none">gone</div></div><div class="cookie-notice">We use</div><footer>f</footer>"""


def test_one_page():
    expected = ["Tést", "One two three <b> four text here is long enough.", "Second para with bold break", "Item one text", "Item two text"]
    assert main_text(blocks_of(PAGE), None) == "\n\n".join(expected)
    assert main_text(blocks_of(PAGE), path_number(("html", "body", "div.content-#"))) == "\n\n".join(expected)


def test_a_part_of_the_article_does_not_win_over_it(spark):
    def page(n):
        parts = f"<h1>Title {n}</h1><p>{'lead ' * 60}</p><div class='body'><p>{'body ' * 600}</p></div>"
        return f"<body><nav>n</nav><article>{parts}<div class='comments'>{'comment ' * 125}</div></article></body>"

    expected = lambda n: "\n\n".join([f"Title {n}", " ".join(["lead"] * 60), " ".join(["body"] * 600)])
    assert main_text(blocks_of(page(1)), None) == expected(1)
    pages = spark.createDataFrame([(f"http://h/{n}", page(n)) for n in range(4)], "url string, html string")
    assert [r.path for r in host_paths(pages).collect()] == [path_number(("body", "article"))]
    assert {r.main_text for r in extracted(pages).collect()} == {expected(n) for n in range(4)}
    headed = f"<header><h1>Site</h1></header><article><header><h1>Own</h1>by</header><div><p>{'text ' * 90}</p></div></article>"
    assert main_text(blocks_of(headed), None) == "Own\n\n" + " ".join(["text"] * 90)


def test_names_of_wrappers_take_nothing_away():
    inner = f"<div class='entry-header'><h1>Title</h1>by me</div><p>{'text ' * 90}</p><div class='site-footer'>foot</div>"
    inner += "<div class='related-posts'><p>other</p></div>"
    text = "Title\n\n" + " ".join(["text"] * 90)
    for name in ("has-sidebar", "no-sidebar", "content-with-nav", "page-header-fixed", "menu-open", "search"):
        for attribute in ("class", "id"):
            page = f"<body><nav>n</nav><div {attribute}='{name}'><article>{inner}</article></div></body>"
            assert main_text(blocks_of(page), None) == text, name
    comments = f"<body><article>{inner}</article><div class='comments'><p>{'comment ' * 300}</p></div></body>"
    assert main_text(blocks_of(comments), None) == text


def test_head_without_an_end():
    page = f"<html><head><title>t</title><style>s</style><body><p>Lead.</p><article><header><h1>T</h1></header><p>{'x ' * 9}</p></article>"
    assert main_text(blocks_of(page), path_number(("html",))) == "Lead.\n\nT\n\nx x x x x x x x x"


def test_odd_pages():
    cases = {
        "": "",
        "<": "<",
        "plain  text": "plain text",
        "<p>a<p": "a",
        "<div hidden>x</div>a < b & c &amp;amp; d": "a < b & c &amp; d",
        "<table><tr><td>a<td>b<tr><td>c</table>": "a\n\nb\n\nc",
        "<!-- <p>no</p> --><p>yes</p><!-- open": "yes",
        "<script>never closed <p>no": "",
        "</p></div><p>x</b></p>y": "x\n\ny",
    }
    for page, text in cases.items():
        assert main_text(blocks_of(page), None) == text, page
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert main_text(blocks_of(deep), None) == "deep"


def test_quotes_and_attributes():
    cases = {
        '<p class=lead">First</p>': "First",
        "<p title=don't>First</p><p>Second isn't lost.</p><p>Third</p>": "First\n\nSecond isn't lost.\n\nThird",
        '<p class="open>one</p><p>two</p>': "one\n\ntwo",
        "<p a='b'c=\"d>e\">f</p>": "f",
        '<p a="x>y" b=z/>t</p><p =x y>u': "t\n\nu",
        "<div hidden=''>x</div><div data-hidden=1>y</div>": "y",
        "<svg/>a<svg>b</svg><p>c": "a\n\nc",
    }
    for page, text in cases.items():
        assert main_text(blocks_of(page), None) == text, page


def test_time_goes_with_the_length_of_a_page():
    pages = {
        "nested": lambda n: "<div>" * n + "<p>some text" * n,
        "unclosed quote": lambda n: "<a " * n + '"',
        "quotes": lambda n: '<p a="' * n,
        "nested marks": lambda n: "<div class=ad>" * n + "<p>word</p>" * n,
        "lone end tags": lambda n: "<div>" * n + "</b>" * n,
        "items": lambda n: "<ul>" + "<div>" * n + "<li>x</li>" * n,
        "hidden without an end": lambda n: "<svg>" * n,
        "inline": lambda n: "<b>" * n + "<p>x" * n,
    }

    def seconds(page):
        best = []
        for _ in range(3):
            begin = time.process_time()
            main_text(blocks_of(page), None)
            best.append(time.process_time() - begin)
        return min(best)

    for name, page in pages.items():
        assert seconds(page(24_000)) < 20 * seconds(page(3_000)) + 0.05, name  # 8 times the length


def test_untidy_pages_without_an_article_tag():
    words = [f"Paragraph {i} of the story goes on for a good while." for i in range(6)]
    menu = "".join(f"<li><a href=/{i}>Entry {i}</a>" for i in range(9))
    page = f"<div id=top><ul>{menu}</ul></div><div class=post><h2>Head<div>" + "".join(f"<p lang=en'>{w}" for w in words)
    page += "</div></div><table><tr><td class=sidebar><p>Most read<td><form>Name <input></form></table><div class=footer>(c)"
    assert main_text(blocks_of(page), None) == "\n\n".join(["Head", *words])


def test_hosts(spark):
    rows = [("http://A.b.example:80/x",), ("https://u@c.d?q",), ("//e.f#g",), ("no host",), ("",), (None,)]
    got = spark.createDataFrame(rows, "url string").select(host_of(F.col("url"))).collect()
    assert [r[0] for r in got] == ["a.b.example", "c.d", "e.f", None, None, None]


def test_pages_of_a_host_agree(spark):
    def page(body):
        return f"<body><div class='x1'><p>{body}</p></div><div class='y'><p>{'link list ' * 4}</p></div></body>"

    rows = [(i, "http://h/%d" % i, page("long text of the article " * 9)) for i in range(5)]
    rows += [(9, "http://h/9", page("short")), (10, None, page("alone " * 30)), (11, "http://h/11", None)]
    rows += [(12, "http://k/", ""), (9, "http://h/9", page("short"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("path", "host", "_host", "_key")})
    assert [tuple(r) for r in host_paths(pages).collect()] == [("h", path_number(("body",)))]
    got = extracted(pages, into="text")
    assert got.columns == [*pages.columns, "text"] and got.count() == len(rows)
    texts = {r.page_id: r.text for r in got.collect()}
    assert texts[11] == texts[12] == "" and texts[9].startswith("short") and texts[10].startswith("alone")
    assert extracted(pages.limit(0)).count() == 0


def test_query_on_the_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = op7_main_text(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", article)
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
        assert r.text == "\n\n".join(t for t in texts if t)
        assert r.n_chars == len(r.text)
