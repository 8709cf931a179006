import re

import pytest
from pyspark.sql import functions as F

from folioscan.llm.html_text import extract_text, main_text

LONG = "The first sentence of it, with a comma. And another one; it goes on for a while, as texts do."

FULL = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1><p>Our slogan, which is long enough to look like text. Really.</p></header>
<nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as everyone does. Please agree, or leave this page now.</p></div>
<div id="sidebar"><p>Side text, not of the article. It has two sentences, and they are long.</p></div>
<!-- <p>hidden</p> -->
<article><h1>The &quot;title&quot; &amp; more</h1><p>{LONG}</p><div class="ad">Buy now. It is cheap, and good.</div>
<p><b>Bold</b>   start<br>and
end.<p>An <a href="/x">inner link</a> in a sentence of the text, <i>here</i>.</p><h2>Short</h2><ul><li>one<li>two</ul></article>
<form><p>Write to us, please. We answer each mail, soon.</p><input name=q></form>
<section class="comments"><p>First reader: I do not agree with this, at all. Not one bit, sorry.</p></section>
<footer>&copy; us &middot; A line, with a full stop. And one more.</footer></body></html>"""


def test_article_without_furniture():
    assert main_text(FULL).split("\n") == [
        'The "title" & more', LONG, "Bold start and end.", "An inner link in a sentence of the text, here.", "Short", "one", "two",
    ]


def test_page_without_article_element():
    page = f'<body><div class="menu"><a href=1>a</a> <a href=2>b</a></div><div id=c><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div><div><a href=3>More links here</a></div></body>'
    assert main_text(page) == f"Head\n{LONG}\n{LONG}"


@pytest.mark.parametrize("page", [None, "", "   ", "<p></p>", "<nav>a</nav>", "<", "<!-- never closed", "<script>x", "</p></div>"])
def test_nothing_to_find(page):
    assert main_text(page) in ("", "<")


def test_broken_markup():
    assert main_text("<article><p>Some text &amp unclosed <b>bold<p>Next 1 < 2") == "Some text & unclosed bold\nNext 1 < 2"
    assert main_text("just text,\n no markup at all") == "just text, no markup at all"
    assert main_text('<article><p title="a > b">x</p><p data-a=\'>\'>y</p></article>') == "x\ny"


def test_very_long_page():
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert main_text(page).count("\n") == 19_999


def test_generated_pages(spark):
    """Pages of the small table: exactly the text of their article elements."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = pages.select("html", extract_text("html").alias("text")).collect()
    import html

    for row in found:
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert row["text"] == "\n".join(b for b in blocks if b)


def test_column(table):
    rows = table([(1, None, "x"), (2, "<article>a</article>", "y"), (2, "<article>a</article>", "y")], "page_id long, html string, text string")
    found = sorted(rows.select("page_id", extract_text(F.col("html"))).collect())
    assert [tuple(r) for r in found] == [(1, ""), (2, "a"), (2, "a")]
    assert table([], "html string").select(extract_text("html")).collect() == []


MENU = '<div><a href="/1">One page</a> <a href="/2">Other page</a></div>'


def test_heading_above_a_wrapped_body():
    body = f"<h1>T</h1><div class=body><p>{LONG}</p><p>{LONG}</p></div>"
    expected = f"T\n{LONG}\n{LONG}"
    for page in (f"<article>{body}</article>", f"<div id=c>{body}</div>", f"<h1>T</h1><div class=wrap><div class=body><p>{LONG}</p><p>{LONG}</p></div></div>"):
        assert main_text(f"<body>{MENU}{page}{MENU}</body>") == expected


@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_small_section_beside_a_large_one(element):
    large, small = f"<section class=a>{f'<p>{LONG}</p>' * 17}</section>", f"<section class=b>{f'<p>{LONG}</p>' * 3}</section>"
    assert main_text(f"<body>{MENU}<{element}>{large}{small}</{element}>{MENU}</body>") == "\n".join([LONG] * 20)


def test_references_inside_an_article():
    items = "".join(f'<li><a href="/{i}">Reference {i}</a></li>' for i in range(5))
    page = f"<article><div class=text><p>{LONG}</p><p>{LONG}</p></div><ul class=refs>{items}</ul></article>"
    assert main_text(f"<body>{MENU}{page}{MENU}</body>") == "\n".join([LONG, LONG, *(f"Reference {i}" for i in range(5))])
    assert main_text(f"<body><div id=c><p>{LONG}</p><p>{LONG}</p></div><ul>{items}</ul></body>") == f"{LONG}\n{LONG}"


def test_several_articles():
    pages = [f"<article class=post-{i}><h2>Post {i}</h2><p>{LONG}</p></article>" for i in "abc"]
    assert main_text(f"<body>{MENU}{''.join(pages)}</body>") == "\n".join(f"Post {i}\n{LONG}" for i in "abc")


ARTICLE = f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article>"
COMMENTS = f'<div id=comments>{"".join(f"<article class=comment><p>{LONG}</p></article>" for _ in range(9))}</div>'


@pytest.mark.parametrize("start, end", [
    ("<div class='content has-sidebar'>", "</div>"), ("<form action=/ method=post>", "</form>"), ("<form><div class='page social'>", "</div></form>"),
    ("<div class='post comments-open'>", "</div>"),
])
def test_furniture_words_around_an_article(start, end):
    side = f"<div class=sidebar><p>{LONG[:40]}</p></div><form><p>Write to us.</p><input name=q></form>"
    for content in (ARTICLE, ARTICLE.replace("article", "main"), ARTICLE.replace("article", "div")):
        assert main_text(f"<body>{MENU}{start}{content}{side}{end}{MENU}</body>") == f"T\n{LONG}\n{LONG}"


def test_two_columns_with_an_article_each():
    page = "".join(f"<div class='banner-{i}'><article><h2>{i}</h2><p>{LONG}</p></article></div>" for i in "ab")
    assert main_text(f"<body>{MENU}{page}</body>") == f"a\n{LONG}\nb\n{LONG}"


def test_comments_beside_an_article_stay_out():
    assert main_text(f"<body>{ARTICLE}{COMMENTS}</body>") == f"T\n{LONG}\n{LONG}"
    assert main_text(f"<body>{COMMENTS}</body>") == "\n".join([LONG] * 9)


@pytest.mark.parametrize("icon", ["<svg width='1' />", '<svg class="i"/>', "<svg/>", "<math/>", "<script src='/a.js' />", "<svg-icon name=x></svg-icon>"])
def test_elements_that_close_themselves(icon):
    assert main_text(f"<article><p>{icon}One.</p><p>Two.</p></article>") == "One.\nTwo."


def test_raw_elements_keep_their_end():
    assert main_text("<article><script src=/a/>var a;</script><p><svg><path d='M0'/><text>no</text></svg>One.</p></article>") == "One."


PARAGRAPHS = "".join(f"<p>Absatz {i} mit etwas mehr Text, der gelesen werden soll, und einem Punkt.</p>" for i in range(6))


def test_furniture_named_in_other_languages_and_hidden_elements():
    expected = "\n".join(f"Absatz {i} mit etwas mehr Text, der gelesen werden soll, und einem Punkt." for i in range(6))
    for furniture in (
        '<div class="publicite"><p>Achetez maintenant, pas cher, ici et tout de suite!</p></div>',
        "<div class='commentaires'><p>Premier commentaire, je ne suis pas du tout d'accord.</p></div>",
        '<div id="werbung"><p>Jetzt kaufen, nur heute, so billig wie nie zuvor!</p></div>',
        '<section class="comentarios"><p>Un comentario de un lector, bastante largo y con comas.</p></section>',
        '<div class="hinweis"><p>Diese Seite verwendet Dinge, denen man zustimmen muss.</p></div>',
        "<div hidden><p>Nicht zu sehen, aber lang genug, um Text zu sein.</p></div>",
        '<div class="x" hidden=""><p>Nicht zu sehen, aber lang genug, um Text zu sein.</p></div>',
        '<div style="color:red; display: none"><p>Nicht zu sehen, aber lang genug, um Text zu sein.</p></div>',
        "<p style='visibility:hidden'>Nicht zu sehen, aber lang genug, um Text zu sein.</p>",
        '<div class="warning"><p>Bitte beachten: das hier ist ein Hinweis und kein Artikel.</p></div>',
    ):
        for page in (f"<body><article>{PARAGRAPHS}{furniture}</article></body>", f"<body><article>{PARAGRAPHS}</article>{furniture}</body>", f"<body><div>{furniture}{PARAGRAPHS}</div></body>"):
            assert main_text(page) == expected, page[:60] + furniture
    for shown in ('<div data-x="hidden">', '<div class="overflow" style="overflow:hidden">', '<div data-state=\'is hidden here\'>', '<div style="display:block">'):
        assert main_text(f"<article>{shown}{PARAGRAPHS}</div></article>") == expected, shown
