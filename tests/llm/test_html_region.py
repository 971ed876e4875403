"""The clusters decide the region, not an element's name; nothing that belongs to the text is lost."""

import pytest

pytest.importorskip("public_tokenizers")

from undertow.llm import html_text  # noqa: E402


def words(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def test_a_short_article_does_not_hide_the_text():
    teaser, text = words("t", 30), words("x", 200)
    page = f"<body><div><article><p>{teaser}</p></article><div><p>{text}</p><p>{text}</p></div></div></body>"
    assert html_text.main_text(page).split("\n") == [teaser, text, text]


def test_sibling_articles_all_stay():
    texts = [words(n, 80) for n in "abc"]
    page = "<body>" + "".join(f"<article><p>{t}</p></article>" for t in texts) + "<footer>f</footer></body>"
    assert html_text.main_text(page).split("\n") == texts


def test_a_list_is_not_the_region():
    items = [words(f"i{k}x", 60) for k in range(8)]
    page = f"<body><h1>Head</h1><p>{words('p', 60)}</p><ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul></body>"
    assert html_text.main_text(page).split("\n") == ["Head", words("p", 60), *items]


def test_the_lighter_part_stays():
    a, b = words("a", 170), words("b", 30)
    page = f"<body><div><p>{a}</p><p>{a}</p></div><div><p>{b}</p><p>{b}</p></div><nav>menu</nav></body>"
    assert html_text.main_text(page).split("\n") == [a, a, b, b]
