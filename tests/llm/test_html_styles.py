"""Style sheets with at-rules and overriding rules: what a reader at a screen sees stays."""

import pytest
from veriscope.llm import html

BODY = "<p class=t>seen <b>words</b></p><div class='t u' id=i>more</div><em>end</em>"
ALL, NONE = ["seen", "words", "more", "end"], ["end"]
CASES = [
    ("@media print { .t { display:none } }", ALL), ("@media (max-width:600px){.t{display:none}} em{color:red}", ALL), (".t{display:none} .t{display:block}", ALL),
    ("@media screen { .t { display:none } }", NONE), ("@media (min-width: 40em) and (max-width:2000px){.t{display:none}}", NONE), (".t{display:block} .t{display:none}", NONE),
    ("@media not print{.t{visibility:hidden}}", NONE), ("@media only screen and (width >= 600px){.t{display:none}}", NONE), ("@media (400px <= width <= 700px){.t{display:none}}", ALL),
    ("@media print, screen{.t{display:none}}", NONE), ("@media(max-width:9px){.t{display:none}}", ALL), ("@media (odd-thing: 3){.t{display:none}}", ALL),
    (".t{display:none!important} .t{display:block}", NONE), (".t{display:none} #i{display:block}", ["more", "end"]), ("#i{display:none} .t{display:block}", ["seen", "words", "end"]),
    (".t{display:none} .u{display:block}", ["more", "end"]), (".t{display:none} .t{visibility:visible}", NONE), (".t{display:none;display:flex}", ALL),
    ("@supports (display:grid){.t{display:none}}", NONE), ("@font-face{src:x} @import 'a'; .t{display:none", NONE), ("@media print{@media screen{.t{display:none}}} ", ALL),
    ("<!-- .t{display:none} -->", NONE), ("em:after{content:'}'} .t{display:none}", NONE), ("@keyframes k{.t{display:none}}", ALL), ("@media x{" * 5000 + "}" * 5000 + ".t{display:none}", NONE),
]


@pytest.mark.parametrize(("sheet", "words"), CASES)
def test_visible_words_under_rules(sheet, words):
    assert html.render(f"<style>{sheet}</style>{BODY}").split() == words


def test_inline_styles_and_media_of_a_sheet():
    assert html.render(f"<style media=print>.t{{display:none}}</style>{BODY}").split() == ALL
    assert html.render(f"<style media='screen'>.t{{display:none}}</style>{BODY}").split() == NONE
    assert html.render("<style>.t{display:none}</style><p class=t style='display:block'>a<p style='display:none;display:block'>b<p style='display:none'>c") == "a\n\nb"
    assert html.render("<style>.t{display:none!important}</style><p class=t style='display:block'>a<p>b") == "b"
