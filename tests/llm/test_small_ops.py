import math
from collections import Counter
from hashlib import sha256

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from veriscope.llm import html, langid, sharding, topk, warc

SF = "/root/testdata/sf0.01"


# sharding


def test_fill_is_even_and_moves_little():
    shards = [f"s{i}" for i in range(10)]
    full, less = sharding.fill(shards, 1009), sharding.fill(shards[:-1], 1009)
    counts = Counter(full)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 10
    moved = sum(a != b for a, b in zip(full, less, strict=True))
    assert moved < 2.5 * counts[9]
    with pytest.raises(ValueError):
        sharding.fill(shards, 1000)
    with pytest.raises(ValueError):
        sharding.fill(["a", "a"], 7)
    assert set(sharding.fill(["a"], 2)) == {0}


def test_place_keeps_rows_and_files(spark, tmp_path):
    df = spark.createDataFrame([(i % 50, "x") for i in range(200)] + [(None, None)], "doc_id long, shard string")
    placed = sharding.place(df, F.col("doc_id"))
    rows = placed.collect()
    table = sharding.fill(sharding.SHARDS)
    for r in rows:
        key = 0 if r.doc_id is None else sharding._hash(str(r.doc_id)) % sharding.SLOTS
        assert (r.slot, r.shard) == (key, sharding.SHARDS[table[key]])
    assert len(rows) == 201 and placed.columns == ["doc_id", "slot", "shard"]
    sharding.write_shards(df.select("doc_id"), F.col("doc_id"), f"file://{tmp_path}/s", shards=["a", "b"], slots=13)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 201
    assert sharding.place(df.limit(0), F.col("doc_id")).count() == 0


# language ID


def test_codewords():
    for n in (2, 3, 4, 5, 12):
        code = langid.codewords(n)
        apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(apart) >= max(1, code.shape[1] // 4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(spark, docs.where(~out))
    assert model.languages == ["de", "en", "es", "fr"]
    rows = langid.identify(docs.where(out), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    half = " ".join(t for r in docs.where("lang = 'fr'").take(1) for t in r.text.split()[:60]) + " " + " ".join(docs.where("lang = 'de'").first().text.split()[:60])
    odd = [(1, None), (2, ""), (3, "123 ,.- ²"), (4, half), (5, "ß")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("old")), model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].ambiguous and got[i].score == 0 for i in (1, 2, 3))
    assert {got[4].lang_pred, got[4].lang_second} == {"fr", "de"} and got[5].lang_pred != "und"


def test_few_languages(spark, nothing):
    model = langid.fit(spark, nothing)
    text = spark.createDataFrame([(1, "words", "aa")], "doc_id long, text string, lang string")
    assert langid.identify(text, model).first().lang_pred == "und"
    assert langid.identify(text, langid.fit(spark, text)).first().lang_pred == "aa"
    assert langid.identify(nothing, model).count() == 0
    two = spark.createDataFrame([(1, "aaaa aaaa", "aa"), (2, "zz zzz", "zz"), (3, None, "qq")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(two, langid.fit(spark, two)).orderBy("doc_id").collect()] == ["aa", "zz", "und"]


# HTML

CASES = [
    (None, ""), ("", ""), ("plain", "plain"), ("a < b &amp;&lt;c&eacute;", "a < b &<cé"),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    ("<title>t</title><body>x<script>var a='<p>'</script><style>.h{display:none} p.x{color:red}</style><span class='a h'>no</span> y", "x y"),
    ("<div hidden>no</div><i style='color:red; DISPLAY : none'>no</i><input type=hidden value=no><b>yes</b>", "yes"),
    ("<ul><li>a<li>b<ol start=9><li>x</li><li>y</ol><li>c</ul>", "- a\n- b\n  9. x\n  10. y\n- c"),
    ("<ol reversed><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n6. c"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>b<td>22</table>", "name       n\nlong name  1\nb          22"),
    ("<table><td>a<td colspan=2>wide<tr><td rowspan=2>b<td>c<td>d<tr><td>e<td>f</table>", "a  wide\nb  c  d\n   e  f"),
    ("<pre>\n a\n  b</pre>t", " a\n  b\n\nt"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"), ("<p><b>x<p>y</b>z", "x\n\nyz"), ("</p>x</nope>", "x"),
    ("<!-- c --><!DOCTYPE html><h1>T</h2>u<hr>v", "T\n\nu\n---\nv"), ("<a href='x>y'>l</a>", "l"), ("x<textarea> a &lt;b> </textarea>", "x a <b> "),
    ("<select><option>a<option>b</select>", "a\nb"), ("日<table><tr><td>日本<td>x<tr><td>a<td>y</table>", "日\n\n日本  x\na     y"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_rendering(page, text):
    assert html.render(page) == text.rstrip()


def test_deep_and_broken_pages():
    assert html.render("<div>" * 30_000 + "x" + "</div>" * 30_000 + "<p>y").split() == ["x", "y"]
    assert html.render("<table>" * 3000 + "<tr><td>x").split() == ["x"]
    assert html.render("<" * 5000) == "<" * 5000
    assert html.render("<a " + "b='" * 2000) == ""
    assert html.render("<!--" * 2000 + "x") == ""


def test_every_visible_word_of_the_pages(spark):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html.extract(pages.withColumnRenamed("html", "page").withColumn("html", F.col("page"))).collect():
        bare = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1\s*>", " ", r.page)
        bare = unescape(re.sub(r"(?s)<[^>]*>", " ", bare))
        missing = Counter(re.findall(r"\w+", bare)) - Counter(re.findall(r"\w+", r.text))
        assert "display:none" in r.page or "hidden" in r.page or "noscript" in r.page or not missing, (r.page_id, missing)


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, "<p>a<p>b", None), (None, "", "")], "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_lines) for r in html.extract(df).collect()), key=str)
    assert got == sorted([(1, "", 0), (1, "a\n\nb", 3), (None, "", 0)], key=str)
    assert html.extract(df.limit(0)).count() == 0


# top-k


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=24).round(1)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]  # one vector many times: ties
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 22), (1020, [math.nan] + [0.0] * 23), (1040, [math.inf] + [0.0] * 23), (1060, [1.0, 2.0]), (1061, [3.0, 4.0]), (1080, [])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), v) for i, v in rows], "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as g").repartition(6)
    got = topk.top_k(df, F.pmod("vec_id", F.lit(20)) == 0, k=20)
    want = brute.top_k(rows, lambda i: i % 20 == 0, 20, 64.0)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_of_nothing_and_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (None, [3.0])], "vec_id long, embedding array<float>")
    ask = F.pmod("vec_id", F.lit(20)) == 0
    assert list(map(tuple, topk.top_k(df, ask).collect())) == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.limit(0), ask).count() == 0


# WARC


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    same = "<p>" + "é" * 100
    rows = [(i, f"http://h{i % 5}.example.com/{i % 7}", same if i % 3 == 0 else f"page {i}") for i in range(1, 60)]
    rows += [(70, None, None), (71, "http://[bad", ""), (None, "x y\n", same), (72, "http://h1.example.com/1", "x" * 99), (73, "http://www.h1.example.com:80/1", "x" * 99), (74, "", "y" * 200), (74, "", "y" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as key").repartition(4)
    archive = warc.write(df)
    got = archive.read(with_payload=True).collect()
    first = min(i for i, _, h in rows if h == same and i is not None)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        later = h == same and i != first
        want.append((i, len(raw), sha256(raw).hexdigest(), "revisit" if later else "response", first if later else None))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    assert {bytes(r.payload).decode() for r in got if r.page_id == first} == {same}
    for url in {u for _, u, _ in rows}:
        key = warc.url_key(url)
        assert sorted((str(c["page_id"]) for c in archive.captures(url))) == sorted(str(i) for i, u, _ in rows if warc.url_key(u) == key)
    assert archive.captures("http://nowhere.example.com/") == []


def test_archive_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    archive = warc.write(empty)
    assert archive.read().count() == 0 and archive.captures("http://a/") == []
