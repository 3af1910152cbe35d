"""Quotes in tags that open no value: the text behind them is kept."""

import pytest

from orrery.llm.html_text import visible_text


@pytest.mark.parametrize(
    "html,text",
    [
        ("<a href=it's>Text</a> and it's more", "Text and it's more"),
        ("<p class=\"x\"\">Hello</p><b title='a'>y</b>", "Hello\n\ny"),
        ("<p 'x>Hi</p><p>o'k</p>", "Hi\n\no'k"),
        ("<a href=x=\"y>z\">k", "z\">k"),
        ("<p a=\"b\"c='>'>d", "d"),
        ("<a href = '>'>c</a>", "c"),
        ("<a =\"x>y\">z</a>", "y\">z"),
        ("<a b= >t", "t"),
        ("<p 'x hidden'>shown</p>", "shown"),
        ("<p 'x hidden>gone</p>z", "z"),
        ("</p title=\"a>b\">c", "c"),
    ],
)
def test_text_behind_stray_quotes(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize("html", ["<a b=\"" * 50_001, "<a b=" * 50_000, "<a " + "= " * 50_000, "<a b= " + " " * 50_000 + "x", "<a b" + "'" * 50_000, "<a " + "b='' " * 50_000])
def test_hostile_quotes_end(html):
    assert isinstance(visible_text(html), str)
