"""Deep elements and long spans."""

import pytest
from veriscope.llm import html


@pytest.mark.parametrize("tag", ["div", "blockquote", "ul><li", "span", "table><tr><td"])
def test_deep_elements(tag):
    n = 480 // {"table><tr><td": 4, "ul><li": 2}.get(tag, 1)  # a tbody is implied
    page = f"<{tag}>" * n + "<p hidden>no</p><ol><li>a<li>b</ol>"
    lines = [x.strip(" -") for x in html.render(page).split("\n")]
    assert lines[-2:] == ["1. a", "2. b"] and "no" not in lines


def test_end_tags_close_the_deep_element():
    page = "<section>" * 250 + "<div hidden>" + "<div>x</div>" * 3 + "</div>seen" + "</section>" * 250
    assert html.render(page) == "seen"


def test_long_spans():
    page = "<table><tr><td rowspan=150>a<td>b" + "<tr><td>c" * 149 + "<tr><td>d<td>e</table>"
    lines = html.render(page).split("\n")
    assert lines[0] == "a  b" and lines[1:150] == ["   c"] * 149 and lines[150] == "d  e"
    page = "<table><tr><td colspan=300>a<td>b<tr>" + "<td>x" * 300 + "<td>y</table>"
    top, low = html.render(page).split("\n")
    assert top.index("b") == low.index("y")
    assert html.render("<table>" + "<tr><td colspan=1000 rowspan=65534>a" * 300 + "</table>").count("a") == 300
