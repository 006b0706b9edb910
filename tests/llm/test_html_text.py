"""Pages whose markup hides the article from a careless reader."""

import time

import pytest

from rasterloom.llm import html_text

TEXT = "The river was wide and the town lay on its other side for many years."
ARTICLE = f"<article><h1>A town and its river</h1><p>{TEXT}</p><p>{TEXT} It is still there.</p></article>"
WANT = f"A town and its river\n\n{TEXT}\n\n{TEXT} It is still there."


@pytest.mark.parametrize("raw", [
    "<script>for(var i=0;i<n;i++){track(i)}</script>", "<script>if(a<b){x='<!--'}</script>", "<style>/* <!-- */ p{}</style>", "<script>a<b</SCRIPT >",
    "<textarea>x <b y</textarea>", "<iframe src=x><a b</iframe>", "<noscript><img src=x alt='</noscript>", "<script>var t='<script>'</script>", "<script src=/a/></script>",
])
def test_raw_text_ends_at_its_own_end_tag(raw):
    assert html_text.extract(f"<html><body>{raw}{ARTICLE}</body></html>") == WANT
    assert html_text.extract(f"<html><head>{raw}<title>T</title></head><body>{ARTICLE}</body></html>") == WANT
    assert html_text.extract(f"<html><body>{ARTICLE}<script>a<b") == WANT


@pytest.mark.parametrize("attributes", ['class="post-content overflow-hidden"', 'data-x="hidden"', 'hidden="until-found"', 'title="display: none"'])
def test_only_hidden_elements_are_left_out(attributes):
    assert html_text.extract(f"<html><body><div {attributes}>{ARTICLE}</div></body></html>") == WANT


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', "style='display:none'", 'aria-hidden="true"'])
def test_an_unclosed_hidden_element_ends_with_its_parent(attributes):
    page = f"<html><body><section><div {attributes}><b>Gone</b> words.</section>{ARTICLE}</body></html>"
    assert html_text.extract(page) == WANT


def test_math_and_objects_keep_their_text():
    words = " ".join(b.text for b in html_text.blocks_of(f"<article><p>{TEXT} <math><mi>x</mi></math> <object>Shown instead.</object></p></article>"))
    assert "x" in words.split() and "Shown instead." in words


@pytest.mark.parametrize("around", [
    '<div class="content with-sidebar">{}</div>', '<div class="page no-comments">{}</div>', '<form id="aspnetForm" action="/">{}</form>', '<div class="overflow-hidden"><div class="lg:hidden-x hidden-xs">{}</div></div>',
    "<p data-x=it's></p>{}", "<div title=it's>{}</div>", "<fieldset>{}</fieldset>", '<div id="modal-open" class="popular">{}</div>', '<a name="x" href="unclosed>{}', "<b><i>{}</i></b>", "<section class=legal>{}</section>",
])
def test_what_wraps_an_article_drops_nothing_of_it(around):
    assert html_text.extract(f"<html><body>{around.format(ARTICLE)}</body></html>") == WANT


@pytest.mark.parametrize(("inner", "said"), [
    (f'<p><a href="/x">{TEXT}</a></p>', TEXT), (f"<p>© {TEXT}</p>", f"© {TEXT}"), (f'<div class="alert-box"><p>{TEXT}</p></div>', TEXT), (f'<div class="legal">{TEXT}</div>', TEXT),
    ("<![CDATA[ gone ]]>", None), ("<!-- gone > still gone -->", None), (f"<p data-x=it's>Don't go. {TEXT}</p>", f"Don't go. {TEXT}"), (f"<blockquote>{TEXT}</blockquote>", TEXT), ("<h2>One more thing</h2>", "One more thing"),
    ('<div class="ad">Buy now at once.</div>', None), ('<section class="comments"><p>I liked this a lot.</p></section>', None), ("<form><p>Write to us here.</p></form>", None), ('<div class="reader-comments"><p>Me too.</p></div>', None),
    ('<aside><p>Another story of the town.</p></aside>', None), ('<div id="cookie-notice"><p>We use cookies on this site.</p></div>', None), (f"<p>{TEXT} a < b and <3</p>", f"{TEXT} a < b and <3"),
])
def test_inside_an_article(inner, said):
    page = f"<html><body><article><h1>A town and its river</h1><p>{TEXT}</p>{inner}<p>{TEXT} It is still there.</p></article></body></html>"
    want = ["A town and its river", TEXT, *([said] if said else []), f"{TEXT} It is still there."]
    assert html_text.extract(page) == "\n\n".join(want)


@pytest.mark.parametrize("opening", ['<article class="post tags popular">', '<article id="comments-open">', '<main class="sponsored"><article>', '<article class="h-entry" style="color:red">'])
def test_an_article_is_one_whatever_its_class(opening):
    assert html_text.extract(f"<html><body>{opening}{ARTICLE.removeprefix('<article>')}</body></html>") == WANT


@pytest.mark.parametrize("head", ["<head><title>T</title>", "<head><meta charset=utf-8><title>T</title><link rel=x>", "<title>T</title>", "<head><title>a < b <p> </title><style>p{}</style>"])
def test_a_head_that_is_never_closed_ends_where_content_begins(head):
    assert html_text.extract(f"<html>{head}{ARTICLE}") == WANT
    assert html_text.extract(f"<html>{head}<body>{ARTICLE}") == WANT


@pytest.mark.parametrize("unit", ['<a "', "<a <", "<a b='", "<a b=\"c='", "<!--", "<div>", "</x>", "<b>x<hr>", "<p>", "<script>", "<![CDATA[", "<div hidden>", "<li>", "<a href=x class=y>", "<", "&amp"])
def test_reading_takes_time_in_proportion(unit):
    page = unit * (400_000 // len(unit))
    began = time.process_time()
    html_text.extract(page)
    assert time.process_time() - began < 4


def test_a_cut_off_tag_is_dropped():
    assert html_text.extract(f"<html><body>{ARTICLE.removesuffix('</article>')}<p class='x") == WANT


def some(n, first=0):
    return " ".join(("water stone river light city years history early study under north small".split() * 9)[first : first + n]).capitalize() + "."


@pytest.mark.parametrize("n", [3, 6, 10, 17, 18, 25])
def test_unmarked_containers_keep_short_paragraphs(n):
    a, b = some(n), some(n, 3)
    menu = "<ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li><li><a href=/c>Three</a></li></ul>"
    for page, want in (
        (f"<body><div><h1>Head</h1><p>{a}</p><p>{b}</p></div></body>", ["Head", a, b]), (f"<body><div class='elementor-widget-container'><h1>Head</h1><p>{a}</p><p>{b}</p></div></body>", ["Head", a, b]),
        (f"<html><body><div><p>{a}</p><p>{b}</p></div></body></html>", [a, b]), (f"<p>{a}</p>", [a]), (f"<section><h1>Head</h1><p>{a}</p></section>", ["Head", a]), (f"<body>{menu}<div><h1>Head</h1><p>{a}</p></div></body>", ["Head", a]),
        (f"<body><table><tr><td>{a}</td><td>{b}</td></tr></table></body>", [a, b]), (f"<body><h1>Head</h1><table><tr><td>{a}</td></tr><tr><td>{b}</td></tr></table></body>", ["Head", a, b]),
    ):
        assert html_text.extract(page) == "\n\n".join(want), page


@pytest.mark.parametrize("n", [8, 20, 30])
@pytest.mark.parametrize("inner", ["<p class='tags-intro'>{}</p>", "<div class='review-form'>{}</div>", "<div class='toc-text'>{}</div>", "<div class='reply'>{}</div>", "<fieldset>{}</fieldset>", "<div class='review-form'><p>{}</p></div>"])
def test_names_alone_take_nothing_from_an_article(inner, n):
    page = f"<article><h1>Head</h1><p>{some(20)}</p>{inner.format(some(n, 4))}<p>{some(22)}</p></article>"
    assert html_text.extract(page) == "\n\n".join(["Head", some(20), some(n, 4), some(22)])


@pytest.mark.parametrize("tag", ["select", "button", "video", "audio", "canvas", "svg", "template"])
def test_an_unclosed_element_that_is_left_out_ends_with_its_parent(tag):
    assert html_text.extract(f"<body><div><{tag}>x</div>{ARTICLE}</body>") == WANT
    assert html_text.extract(f"<body><div><{tag}>x</{tag}></div>{ARTICLE}</body>") == WANT
    if tag in ("select", "button", "video", "audio"):
        assert html_text.extract(f"<body><{tag}>x{ARTICLE}</body>") == WANT
    assert html_text.extract(f"<body><div><select><option>a<option>b</div>{ARTICLE}</body>") == WANT


def test_held_out_pages():
    """Pages of the generator that it was not grown on; most exactly right, few lose a block."""
    pages = list(html_text.labelled_pages(300, seed=99))
    texts = [html_text.extract(page) for page, _ in pages]
    assert sum(t == "\n\n".join(main) for t, (_, main) in zip(texts, pages, strict=True)) >= 285
    assert sum(bool(set(main) - set(t.split("\n\n"))) for t, (_, main) in zip(texts, pages, strict=True)) <= 9
