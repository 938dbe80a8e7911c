import html
import re

from cohortspark.llm import html_extract
from cohortspark.llm.html_extract import main_text
from tests.conftest import SF_SMALL
from tests.llm.conftest import rows

PARAGRAPH = "A long paragraph of running text that goes on for a while, with many words in it. "


def test_article_between_furniture():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
      <header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
      <div class="cookie-notice">We use cookies</div><div class=ad>Buy</div>
      <div class="page-header">Slogan</div>
      <main><article><header class="entry-header"><h1>The  title &amp; more</h1></header>
      <p>{PARAGRAPH}<b>bold</b>ly &lt;done&gt;</p><p>Short.</p><ul><li>One<li>Two &#233;</ul>
      <script>var x = "</p>";</script><!-- no --><aside>Aside</aside>
      <form><p>Sign up</p><button>Go</button></form>
      <table><tr><td>1<td>2</table></article>
      <section id="comments"><article class="comment"><p>{PARAGRAPH}</p></article></section>
      </main><div class="sidebar"><p>{PARAGRAPH}</p></div><footer>&copy; us</footer>"""
    assert main_text(page).split("\n") == [
        "The title & more", PARAGRAPH + "boldly <done>", "Short.", "One", "Two é", "1", "2"]


def test_region_without_an_article():
    page = f"""<body><div>Home News About</div><div class="post"><h2>Title</h2><p>{PARAGRAPH}</p>
      <p>Short.</p><ul><li>One</ul></div><div id="related"><p>{PARAGRAPH}</p></div>
      <section id="comments"><p>{PARAGRAPH}</p></section></body>"""
    assert main_text(page).split("\n") == ["Title", PARAGRAPH.strip(), "Short.", "One"]


def test_the_region_keeps_what_lies_around_its_clusters():
    long = "\n".join([PARAGRAPH.strip()] * 5)
    ps = f"<p>{PARAGRAPH}</p>" * 5
    page = f"<div class=post><h1>T</h1><p>lead</p><div class=entry>{ps}</div><p>tail</p></div>"
    want = f"T\nlead\n{long}\ntail"
    assert main_text(page) == want
    assert main_text(f"<html><body><div>Home</div>{page}</body></html>") == want
    items = [f"Item {k}" for k in range(8)]
    page = ps + "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" + ps
    want = "\n".join([long, *items, long])
    assert main_text(f"<html><body><nav>Menu</nav>{page}</body></html>") == want
    assert main_text(page) == want


def test_names_mark_no_wrapper_of_the_article():
    p = f"<p>{PARAGRAPH}</p>"
    text = "\n".join(["T", *[PARAGRAPH.strip()] * 3])
    rest = f"<div class=sidebar><article>{p}</article></div><section id=comments>{p * 2}</section>"
    for name in ("layout has-sidebar", "content no-sidebar", "entry-content read-more",
                 "blog-post with-comments", "search-results", "container main-nav-open",
                 "has-header", "content-sidebar", "site-header", "comments"):
        for inner in (f"<h1>T</h1>{p * 3}", f"<article><h1>T</h1>{p * 3}</article>",
                      f"<main><h1>T</h1>{p * 3}</main>"):
            assert main_text(f"<body><div class='{name}'>{inner}</div></body>") == text, name
            if name != "comments":
                page = f"<body><div class='{name}'>{inner}{rest}</div></body>"
                assert main_text(page) == text, page
    form = f"<form action=x><div class=menu>Home</div><article><h1>T</h1>{p * 3}</article>{rest}"
    assert main_text(f"<body>{form}</form></body>") == text
    # others' text is none of the page's, be it longer, nor are articles in it
    post = f"<div class=post><h1>T</h1>{p * 3}</div>"
    for other in ("comments", "related-posts", "post-comments"):
        for inner in (p * 20, f"<article>{p * 20}</article>"):
            assert main_text(f"<body>{post}<div class={other}>{inner}</div></body>") == text
    for other in ("site-footer", "main-nav", "left-sidebar", "cookie-notice"):
        assert main_text(f"<body><div>{post}<div class={other}>{p}</div></div></body>") == text
    assert main_text("<div class=comment>" * 3000 + PARAGRAPH) == PARAGRAPH.strip()


def test_an_article_keeps_its_own_parts():
    """Names inside an article name its sections; lists of links still go."""
    p = f"<p>{PARAGRAPH}</p>"
    text = PARAGRAPH.strip()
    for name in ("discussion", "side-by-side", "alert-box", "social-impact", "search",
                 "foot-notes", "tags-explained", "more-results", "login-study"):
        for attr in ("id", "class"):
            page = f"<article><h1>T</h1>{p * 2}<section {attr}='{name}'><h2>S</h2>{p}</section>{p}"
            assert main_text(f"<body><nav>M</nav>{page}</article></body>") == "\n".join(
                ["T", text, text, "S", text, text]), name
            links = "<a href=/x>one more page</a> <a href=/y>and another</a>"
            page = f"<article><h1>T</h1>{p * 2}<div {attr}='{name}'>{links}</div>{p}</article>"
            assert main_text(f"<body>{page}</body>") == "\n".join(["T", text, text, text]), name
    for name in ("comments", "related", "newsletter", "ad", "share", "notice"):
        page = f"<article><h1>T</h1>{p * 3}<div class='{name}'><p>short words</p></div></article>"
        assert main_text(f"<body>{page}</body>") == "\n".join(["T", text, text, text]), name


def test_formulas_and_comment_marks_in_scripts():
    page = ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>"
            " hold.</p><p>text <script>document.write('<!-- x')</script> last words</article>")
    assert main_text(page) == "Let x=2 hold.\ntext last words"
    assert main_text("<p>a<!-- x --><p>b<!-- open <p>c") == "a\nb"
    assert main_text("<p>a --> b") == "a --> b"


def test_pages_without_an_article_keep_title_and_text_beside_the_region():
    p = f"<p>{PARAGRAPH}</p>"
    text = PARAGRAPH.strip()
    links = "<div>" + "".join(f"<a href=/{k}>Another page {k}</a> " for k in range(12)) + "</div>"
    page = f"<body>{links}<h1>Title</h1><div class=post>{p * 12}</div><div>{PARAGRAPH}</div>{links}</body>"
    assert main_text(page).split("\n") == ["Title", *[text] * 13]
    columns = f"<body><nav>M</nav><div class=left>{p * 4}</div><div class=right>{p * 4}</div></body>"
    assert main_text(columns).split("\n") == [text] * 8


def test_the_clusters_decide(monkeypatch):
    """Another clustering of the lines gives another text."""
    import numpy as np
    p = f"<p>{PARAGRAPH}</p>"
    teaser = "<article><h2>Next</h2><p><a href=/n>Read <b>on</b> <i>here</i></a></p></article>"
    two = f"<body><article><h1>T</h1>{p * 6}</article>{teaser * 2}</body>"
    none = f"<body><div>Home <b>News</b></div><div class=post>{p * 6}</div><div>Up <b>top</b></div></body>"
    want = ["\n".join(["T", *[PARAGRAPH.strip()] * 6]), "\n".join([PARAGRAPH.strip()] * 6)]
    assert [main_text(two), main_text(none)] == want
    monkeypatch.setattr(html_extract, "content_clusters", lambda r: (np.ones(len(r), bool), r < 20))
    assert main_text(two) != want[0] and main_text(none) != want[1]


def test_broken_and_plain_markup():
    assert main_text("plain text only") == "plain text only"
    assert main_text("<p>a<p>b") == "a\nb"
    assert main_text("<p>") == "" and main_text("<!-- open") == ""
    assert main_text("<article><p>a &lt b &nosuch; &#x41;</p><p>unclosed <b>b") == (
        "a < b &nosuch; A\nunclosed b")
    deep = "<div>" * 3000 + PARAGRAPH
    assert main_text(deep) == PARAGRAPH.strip()


def test_a_head_without_its_end_tag():
    head = "<html><head>\n<meta charset=utf-8><title>T</title><style>p{}</style>\n"
    page = f"<article><h1>A</h1><p>{PARAGRAPH}</p></article>"
    want = f"A\n{PARAGRAPH.strip()}"
    for between in ("", "<body>", "</head>", "</head><body>", "<img src=x>", "<noscript>n</noscript>"):
        assert main_text(head + between + page) == want, between
    assert main_text(f"{head}{PARAGRAPH}<p>b") == f"{PARAGRAPH.strip()}\nb"
    assert main_text(f"{head}<template><p>t</p></template><link rel=x></head>") == ""


def test_pages_against_their_template(spark, checkpoints):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_main_text(pages).collect()}
    for r in pages.collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split())
                  for b in re.split("</?p>|</?h1>", body)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (
            r.url, want, len(want))


def test_edges(spark, checkpoints):
    pages = spark.createDataFrame(
        [(1, None, None), (None, "u", "<p>é　x</p>"), (2, "u", ""), (2, "u", ""),
         (3, "u", "<article>" + f"<p>{PARAGRAPH}</p>" * 5000)],
        "page_id long, url string, html string")
    for name in ("text", "n_chars"):
        pages = pages.withColumn(name, pages["page_id"])
    got = rows(html_extract.extract_main_text(pages).select("page_id", "url", "n_chars"))
    assert got == sorted([(1, None, 0), (None, "u", 3), (2, "u", 0), (2, "u", 0),
                          (3, "u", 5000 * len(PARAGRAPH.strip()) + 4999)], key=repr)
    assert rows(html_extract.extract_main_text(pages.limit(0))) == []
