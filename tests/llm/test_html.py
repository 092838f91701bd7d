import random
import pytest

from vitalgrid.llm import html_extract
from vitalgrid.llm.html_extract import extract, extract_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this page and like to tell you so at some length.</div><div class="ad">Buy this thing now, it is a very good thing.</div>
<article><h1>Head &amp; title</h1><p><b>First   paragraph\n with &lt;tags&gt; &eacute; that is long enough.<br><p>Of.</p>
<aside>Related reading that is not part of it</aside><div class="comments"><p>A reader's comment of some length is here.</p></div><p>Last one.</p></article>
<div class="sidebar"><p>Sidebar text that goes on for a while here.</p></div><form><label>Mail</label></form><footer>&copy; me</footer>"""


@pytest.mark.parametrize(
    "html, text",
    [
        (PAGE, "Head & title\n\nFirst paragraph with <tags> é that is long enough.\n\nOf.\n\nLast one."),
        (None, ""),
        ("", ""),
        ("<nav>only a menu</nav>", ""),
        ("plain words", "plain words"),
        ("<p>a<p>b</p>", "a\n\nb"),
        ("<div><p>no article here but a long enough text</p><p>Short.</p></div><div class='footer'>x</div>", "no article here but a long enough text\n\nShort."),
        ("<nav>left open <article><p>still found</p></article>", "still found"),
        ("<p>cut off &am", "cut off &am"),
    ],
)
def test_pages(html, text):
    assert extract_text(html) == text


def test_table(spark):
    rows = [(1, PAGE, "u"), (1, PAGE, "u"), (2, None, None), (3, "<p>" + "word " * 50000 + "</p>", "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r.page_id, r.n_chars, len(r.text)) for r in extract(df, keep=["page_id"]).collect())
    assert got[2] == (2, 0, 0) and got[0] == got[1] and got[3][1] == got[3][2] == 249999
    assert extract(df.limit(0)).columns == ["page_id", "html", "text", "n_chars"]


LONG = "A long sentence of the main text, with commas and enough words to count as content."


def page(*lines):
    return "\n\n".join(lines)


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<div id=c><h1>Title</h1><div class=t>{LONG}</div></div>", page("Title", LONG)),
        (f"<div><div class=by>By me</div><div>{LONG}</div></div>", page("By me", LONG)),
        (f"<body><div><p>{LONG}</p><blockquote>Short quote</blockquote><p>{LONG}</p></div></body>", page(LONG, "Short quote", LONG)),
        (f"<div><p>{LONG}</p><table><tr><td>a</td><td>b</td></tr></table><p>{LONG}</p></div>", page(LONG, "a", "b", LONG)),
        ("<div>" + f"<section><p>{LONG * 9}</p></section><section><h2>Two</h2><p>Short.</p></section>" * 2 + "</div>", page(LONG * 9, "Two", "Short.", LONG * 9, "Two", "Short.")),
        (f"<div><h1>T</h1><p>{LONG * 5}</p></div><article class=card>Teaser text</article>", page("T", LONG * 5, "Teaser text")),
        ("<div><a href=1>Link one</a> <a href=2>Link two</a></div>" + f"<div><p>{LONG}</p><p>{LONG}</p></div>", page(LONG, LONG)),
    ],
)
def test_regions_keep_all_of_the_text(html, text):
    assert extract_text(html) == text


@pytest.mark.parametrize("name", ["content with-sidebar", "no-sidebar", "post category-social", "tag-search", "comment-open", "sidebar", "widget"])
@pytest.mark.parametrize("tag", ["article", "div", "wrapper"])
def test_name_of_the_main_text(name, tag):
    text = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p>"
    html = f"<div class='{name}'><article>{text}</article></div>" if tag == "wrapper" else f"<{tag} class='{name}'>{text}</{tag}>"
    assert extract_text(html + "<div class='cookie-notice'>We use cookies.</div>") == page("Title", LONG, "Short.")


@pytest.mark.parametrize("part", ["section id='related-work'", "h2 id='Social_structure'", "h2 id='Search_and_rescue'", "h2 id='Recommendations'", "div id='Recommendations'", "div class='informed-consent'"])
def test_name_of_a_part_of_the_text(part):
    body = f"<p>{LONG * 2}</p><{part}>{LONG}</{part.split()[0]}><p>{LONG}</p>"
    assert extract_text(f"<article>{body}</article>") == extract_text(f"<div>{body}</div>") == page(LONG * 2, LONG, LONG)


@pytest.mark.parametrize("name", ["sidebar", "side-bar", "cookie-notice", "main-nav", "comments-area", "site-footer", "share_buttons", "ads", "related-posts"])
def test_names_of_boilerplate(name):
    links = "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>"
    for body in (f"<article><p>{LONG}</p><p>{LONG}</p></article><div class='x {name}'>{links}</div>", f"<div><p>{LONG}</p><p>{LONG}</p><div class='{name}'>{links}</div></div>"):
        assert extract_text(body) == page(LONG, LONG)


def test_parts_of_an_article_keep_their_names():
    body = f"<p>{LONG}</p><p id='comment-on-method'>On the method.</p><section class='social history'><p>Their history.</p></section>"
    assert extract_text(f"<article class='search-results'>{body}</article>") == page(LONG, "On the method.", "Their history.")


def test_ratios_choose_the_region(monkeypatch):
    """Lists of links without any telling tag or name go by their ratios alone."""
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(12)) + "</ul></div>"
    html = f"<body>{links}<div><h2>On it</h2><p>{LONG * 2}</p><p>{LONG * 2}</p><p>Short end.</p></div>{links}</body>"
    wanted = page("On it", LONG * 2, LONG * 2, "Short end.")
    assert extract_text(html) == wanted
    monkeypatch.setattr(html_extract, "_smooth", lambda values: [1.0] * len(values))
    assert extract_text(html) != wanted


def test_a_form_around_the_page_is_no_boilerplate():
    page = '<body><form id="aspnetForm"><div id="content"><h1>The title of it</h1><p>{0}</p><p>{0}</p></div><input type="submit"><button>Go</button></form></body>'.format("A long sentence of the main text stands here. " * 4)
    got = html_extract.extract_text(page)
    assert got.startswith("The title of it\n\nA long sentence") and "Go" not in got
    small = "<article><h1>Title</h1><p>{0}</p><form><label>Your mail</label><input></form><p>{0}</p></article>".format("A long sentence of the main text stands here. " * 4)
    assert "Your mail" not in html_extract.extract_text(small) and html_extract.extract_text(small).count("A long sentence") == 8
    role = '<div role="form"><div><p>{0}</p></div></div>'.format("A long sentence of the main text stands here. " * 4)
    assert html_extract.extract_text(role).count("A long sentence") == 4


def test_notices_and_banners_inside_an_article_go():
    text = "A long sentence of the main text stands here. " * 5
    page = f'<article><div class="notice">We use cookies.</div><h1>Title</h1><p>{text}</p><div class="banner">Subscribe to us.</div><section class="related-work"><h2>Related work</h2><p>{text}</p></section><div class=notice><p>Short <b>notice</b> <i>here</i>.</p></div></article>'
    got = html_extract.extract_text(page)
    assert "cookies" not in got and "Subscribe" not in got and "notice" not in got
    assert "Related work" in got and got.count("A long sentence") == 10


def soup(k):
    """A page without any element or name that tells its parts: link lists, the text in blocks or table cells, a foot of links."""
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    links = lambda n: "".join(f'<div><a href="#">{word()}</a> <a href="#">{word()}</a></div>' for _ in range(n))
    says = [" ".join(word() for _ in range(rng.randint(25, 60))) + "." for _ in range(rng.randint(3, 8))]
    body = "".join(f"<tr><td>{x}</td></tr>" if k % 3 == 1 else f"<div>{x}</div>" for x in says)
    body = f"<table>{body}</table>" if k % 3 == 1 else f"<div>{body}</div>"
    page = f"<body><div>{links(rng.randint(4, 9))}</div>{body}<div>{links(rng.randint(3, 7))}</div></body>"
    return (f"<form>{page}</form>" if k % 3 == 2 else page), "\n\n".join(says)


def test_ratios_decide_where_nothing_else_does(monkeypatch):
    pages = [soup(k) for k in range(60)]
    got = [html_extract.extract_text(p) for p, _ in pages]
    assert sum(g == want for g, (_, want) in zip(got, pages)) >= 57
    monkeypatch.setattr(html_extract, "_smooth", lambda values: [1.0] * len(values))
    changed = sum(html_extract.extract_text(p) != g for (p, _), g in zip(pages, got))
    assert changed >= 55
