"""Text that attribute values, forms and wrappers must not cost, and parts that still go."""

import pytest

from acacia.llm.pages import extract

LONG = "The path leads down to the river and along its bank for an hour. " * 3
ARTICLE = f"<article><h1>Walks</h1><p>{LONG}</p></article>"
TEXT = f"Walks\n{LONG.strip()}"
MENU = '<nav><a href="/">Home</a></nav><div class="menu"><a href="/a">All walks</a></div>'


@pytest.mark.parametrize(
    "attributes",
    ['href="/trips/hidden-valley-0"', 'title="a hidden gem"', 'data-hidden="false"', 'data-role="dialog"', "title='class=\"ads\" here'", 'data-class="ads" data-id="menu"', 'alt="x role=navigation"', 'aria-hidden="false"', 'href=/hidden/role'],
)
@pytest.mark.parametrize("tag", ["a", "p", "div"])
def test_words_of_values_hide_nothing(attributes, tag):
    page = f"<body><article><p>Walk to</p><{tag} {attributes}>the valley</{tag}><p>today.</p></article></body>"
    assert extract(page).split() == ["Walk", "to", "the", "valley", "today."]


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', "hidden='until-found' class=x", 'aria-hidden="true"', 'role="navigation"', 'ROLE=" navigation "', 'class="ads"', 'id=menu', 'class="ads" class="text"'])
def test_marks_still_skip(attributes):
    assert extract(f"<body><article><p>Stays.</p><div {attributes}>Goes.</div></article></body>") == "Stays."


@pytest.mark.parametrize(
    "start, end",
    [
        ('<form id="aspnetForm">', "</form>"),
        ('<div class="content social">', "</div>"),
        ('<div class="page share">', "</div>"),
        ('<div role="dialog">', "</div>"),
        ("<dialog open>", "</dialog>"),
        ('<form><div class="page share"><div role="form">', "</div></div></form>"),
    ],
)
@pytest.mark.parametrize("mark", [True, False])
def test_wrappers_keep_the_page(start, end, mark):
    body = ARTICLE if mark else ARTICLE.replace("article>", "div>")
    assert extract(f"<html><body>{start}{MENU}{body}<footer>Imprint</footer>{end}</body></html>") == TEXT


def test_a_wrapped_article_beside_other_text():
    assert extract(f'<body><div>Some words of the site.</div><form id="f">{MENU}{ARTICLE}</form></body>') == TEXT


@pytest.mark.parametrize(
    "other",
    [
        "<form><p>Your name</p><input><button>Send</button></form>",
        f'<div class="block comments"><article><p>{LONG}</p></article></div>',
        f'<div class="comments"><article class="comment"><p>{LONG}</p></article></div>',
        '<div class="cookie box"><p>We use cookies.</p></div>',
        f'<div class="related links"><p>{LONG}</p></div>',
    ],
)
def test_forms_and_comments_go(other):
    assert extract(f"<body><div><p>A short note on the walk to the lake, and on its way back.</p></div>{other}</body>") == "A short note on the walk to the lake, and on its way back."
    assert extract(f"<body>{ARTICLE}{other}</body>") == TEXT


def test_a_form_without_running_text():
    assert extract("<body><form>Name <input> <button>Send</button></form></body>") == ""


def test_role_main():
    assert extract(f'<body><div>Elsewhere</div><div role="main"><p>{LONG}</p></div></body>') == LONG.strip()
