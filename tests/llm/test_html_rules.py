"""Elements that must not swallow the text behind them."""

import pytest

from tillsight.llm import html_cut
from tillsight.llm.html_blocks import scan

TEXT = "These words stand behind the element and belong to the page."


@pytest.mark.parametrize("piece", [
    "<svg-icon name='x'></svg-icon>", "<title-bar>", "<template-part/>", "<iframe-embed src='a'>", "<math-field></math-field>", "<script-host>", "<style-guide>",
    "<svg width='1' title='a > b'/>", "<math/>", "<svg viewBox=\"0 0 1 1\" />", "<svg><path d='M0'/></svg>", "<script>var a = '<p>no</p>'</script>", "<svg class=x><g/><text>no</text></svg\n>"])
def test_text_behind_an_element_stays(piece):
    assert [b.text for b in scan(f"<article><p>First part.</p>{piece}<p>{TEXT}</p></article>") if b.text != "no"] == ["First part.", TEXT]
    assert html_cut.main_text(f"<article>{piece}<p>{TEXT}</p></article>") == TEXT


def test_raw_element_cut_off_at_the_end():
    assert [b.text for b in scan("<p>one</p><script")] == ["one"]
    assert [b.text for b in scan("<p>one</p><svg><text>no")] == ["one"]


BODY = " ".join(f"Plain words of an article that says number {i} at some length." for i in range(9))
PAGE = "<nav><a href='/'>Home</a></nav><article class='post'><h1>Head</h1><p>{}</p><p>Short end.</p></article><div class='comments'><p>A reader says so.</p></div><footer>Legal words here</footer>".format(BODY)


@pytest.mark.parametrize("page", [
    "<html><body class='has-sidebar'>{}</body></html>", "<html class='menu-closed'><body>{}</body></html>", "<body class='sidebar'>{}</body>",
    "<body><div class='content-sidebar-wrap'>{}</div></body>", "<body><form id='aspnetForm'>{}</form></body>", "<body><div class='overlay'>{}</div></body>"])
def test_names_of_the_whole_page_do_not_decide(page):
    text = html_cut.main_text(page.format(PAGE))
    assert BODY in text and "Short end." in text and "Head" in text
    assert not any(x in text for x in ("Home", "A reader", "Legal"))


@pytest.mark.parametrize("name", ["sidebar", "cookie-banner", "navMenu", "comments", "related"])
def test_named_pieces_stay_out(name):
    piece = f"<div class='{name} x'><p>{BODY[:200]} Aside.</p></div>"
    for page in (f"<body>{piece}<article><p>{BODY}</p></article></body>", f"<body><main class='content'><p>{BODY}</p><p>{BODY}</p>{piece}</main></body>"):
        text = html_cut.main_text(page)
        assert BODY in text and "Aside" not in text


def test_article_outweighs_a_named_place():
    one = f"<article class='post'><p>{BODY}</p><p>Then {BODY}</p></article>"
    text = html_cut.main_text(f"<body><div class='related'>{one}</div><div class='text'><p>And {BODY}</p><p>{BODY}</p></div></body>")
    assert text.split("\n") == [BODY, f"Then {BODY}", f"And {BODY}", BODY]
    reader = f"<article class='comment'><div class='text'><p>{BODY}</p><p>{BODY}</p></div></article>"
    assert html_cut.main_text(f"<main>{one}{reader}</main>").split("\n") == [BODY, f"Then {BODY}"]
