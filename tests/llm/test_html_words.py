"""Visible words of whole pages against a walk by the standard library's parser; names and spans that are hard."""

import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F
from veriscope.llm import html

SF = "/root/testdata/sf0.01"
UNSEEN = {"script", "style", "title", "head", "template", "noscript", "object", "video", "audio", "iframe", "svg", "canvas", "datalist"}


class Walk(HTMLParser):
    """Words of a page in order; what is hidden by tag, attribute, inline style or a plain class rule is left out."""

    def __init__(self, page):
        super().__init__()
        sheets = " ".join(re.findall(r"(?is)<style[^>]*>(.*?)</style", page))
        self.classes = {c for c, body in re.findall(r"\.([\w-]+)\s*\{([^}]*)\}", sheets) if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", body)}
        self.open, self.words = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        hidden = tag in UNSEEN or "hidden" in a or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")) or self.classes & set(a.get("class", "").split())
        if tag in {"p", "div", "h1", "h2", "h3", "ul", "ol", "table"} and self.open and self.open[-1][0] == "p":
            self.open.pop()
        if tag == "li" and self.open and self.open[-1][0] == "li":
            self.open.pop()
        if tag not in html.VOID:
            self.open.append((tag, bool(hidden)))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if not any(h for _, h in self.open):
            self.words += re.findall(r"\w+", data)


def test_all_pages(spark):
    n = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").where("html is not null").collect():
        text = re.sub(r"(?m)^ *\d+\. ", "", html.render(r.html))
        assert sorted(re.findall(r"\w+", text)) == sorted(Walk(r.html).words), r.page_id
        n += 1
    assert n > 200


CASES = [
    ("<p class=it's>Visible word <b>don't</b> end</p>tail", "Visible word don't end\n\ntail"),
    ("<a href=x'y\"z>one</a> <i title = \"a>b\" b='<c>'d>two</i>", "one two"),
    ("<p a=b/c=d>x</p><br/>y", "x\n\n\ny"),
    ("<b>x<p>y</b>z</p>w", "x\n\nyz\n\nw"),
    ("<b hidden>x<p>y</b>z</p>w", "z\n\nw"),
    ("<p><b hidden>x<p>y</b>z", "z"),
    ("<i hidden>1<b>2</i>3</b>4", "34"),
    ("<b><div>1<div>2</b>3</div>4</div>5", "1\n23\n4\n5"),
    ("<table><tr><td><b hidden>x<td>y</table>z", "  y\n\nz"),
    ("<a hidden>1<a>2</a>3", "23"),
    ("<ol start='5x'><li value=' 7'>a<li>b</ol>", "7. a\n8. b"),
    ("<ol start=99999999999><li>a</ol>", "2147483647. a"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c<hr></div>d", "b\nd"),
    ("<style>.v{visibility:hidden}.s{visibility:visible}</style><ul class=v><li>a<li class=s>b</ul><table class=v><tr><td>c<td class=s>d<tr class=s><td>e</table>f", "- b\n\n   d\ne\n\nf"),
    ("<p style='display:none'>a<b style='display:block;visibility:visible'>b</b></p>c", "c"),
    ("x</>y</ z>w<!d>v<?p?>u", "xywvu"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_hard_cases(page, text):
    assert html.render(page) == text


def test_many_formatting_elements():
    assert html.render("<b>" * 5000 + "x" + "<p>" * 50 + "y").split() == ["x", "y"]
    assert html.render("<b><i><u>" + "<div>" * 200 + "x</b>y</i>z" + "</div>" * 200 + "w").replace("\n", "") == "xyzw"
    assert html.render("".join(f"<p><font size={i}>w{i}" for i in range(60))).split() == [f"w{i}" for i in range(60)]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "<p>a")], "page_id long, html string")
    names = ["_html", "__html", "__text", "__n", "c0", "n", "html_", "a`b", "a.b"]
    got = html.extract(df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)]))
    row = got.first()
    assert got.columns == ["page_id", *names, "text", "n_lines"] and row.text == "a" and [row[c] for c in names] == list(range(len(names)))
