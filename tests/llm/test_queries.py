"""Every registered query of the subpackage on whole small tables: against SQL, or against plain versions row by row."""

import json
import math
import zlib
from hashlib import sha256
from pathlib import Path

import brute
import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from veriscope.llm import langid, queries

SF = "/root/testdata/sf0.01"
LETTERS = {"aa": "abcdef", "bb": "uvwxyz", "cc": "éèñklm"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    need = sorted(map(str, want.fetchall()))
    assert need and sorted(str(tuple(r)) for r in got.select(*columns).collect()) == need


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang): three invented languages, copies, near copies, passages, benchmark items, odd texts."""
    rng = np.random.default_rng(4)

    def text(lang, n):
        letters = list(LETTERS[lang])
        return " ".join("".join(rng.choice(letters, rng.integers(2, 8))) for _ in range(n))

    out, passage, item = [], text("aa", 60), text("aa", 30)
    for i in range(120):
        lang = ("aa", "bb", "cc")[i % 3]
        out.append((i, text(lang, int(rng.integers(8, 150))), lang))
    near = out[0][1].split() + text("aa", 60).split()
    for i in range(12):
        words = list(near)
        words[int(rng.integers(len(words)))] = "fade"
        out.append((200 + i, " ".join(words), "aa"))
    out += [(300 + i, out[1][1], "bb") for i in range(8)]
    out += [(400 + i, f"{text('aa', 20)} {passage}\n{text('aa', 25)}", "aa") for i in range(6)]
    out += [(500 + i, f"{text('aa', 15)} {item} {text('aa', 15)}", "aa") for i in range(3)]
    out += [(600, None, "aa"), (601, "", None), (602, "123 ... 4", "bb"), (603, " \n\t", None), (604, text("cc", 4000), None), (605, text("aa", 12) + " " + text("bb", 12), None)]
    return out, item


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """A folder of tables with the fixture's rows and columns whose names clash with what operators use within."""
    at = tmp_path_factory.mktemp("tables")
    more = ["_id", "_text", "__text", "__slot", "__gone", "_html", "slot", "id", "c0", "h", "n", "vid", "token", "hits", "m"]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows[0]], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select("*", *[F.lit("x").alias(c) for c in more]).repartition(4).write.parquet(f"file://{at}/documents.parquet")
    items = [(1, rows[1]), (2, "nowhere at all in any of these texts here"), (3, None), (None, "zz")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    same = "<p>" + "ab " * 60
    pages = [(i, f"http://a{i % 3}.org/{i}", same if i % 4 == 0 else f"<b>page {i}") for i in range(1, 30)] + [(40, None, None), (41, "u", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").select("*", F.lit(1).alias("_html"), F.lit(1).alias("text_")).repartition(3).write.parquet(f"file://{at}/pages.parquet")
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(90)] + [(100, None), (120, [1.0, None] + [0.0] * 4), (140, [math.nan] + [0.0] * 5)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("mark", F.lit(3)).write.parquet(f"file://{at}/embeddings.parquet")
    return f"file://{at}", pages, vectors


def run(spark, folder, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder[0]).collect()]


def test_op1(spark, folder, rows):
    from veriscope.llm import sharding

    table = sharding.fill(sharding.SHARDS)
    for r in run(spark, folder, "op1_sharding"):
        assert r["slot"] == sharding._hash(str(r["doc_id"])) % sharding.SLOTS and r["shard"] == sharding.SHARDS[table[r["slot"]]]


def test_op3(spark, folder, rows):
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in run(spark, folder, "op3_decontamination")}
    texts = [t for _, t, _ in rows[0]]
    want = brute.find_items(texts, [(1, rows[1]), (2, "nowhere at all in any of these texts here")])
    assert got == {(rows[0][d][0], i): s for (d, i), s in want.items()} and len(got) >= 3


def _cut(spark, folder, name, file, end):
    tok = Tokenizer.from_file(public_tokenizers.path(file))
    return {i: [*tok.encode(t or "", add_special_tokens=False).ids, end] for i, t, _ in folder}


def test_op4(spark, folder, rows):
    ids = _cut(spark, rows[0], "op4", "byte_bpe_50k.json", 0)
    pieces = sorted(run(spark, folder, "op4_packing"), key=lambda r: (r["sequence_id"], r["offset"]))
    at = {}
    for p in pieces:
        whole = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(whole) and p["ids_crc32"] == brute.crc(whole[p["start"] : p["start"] + p["length"]])
        assert p["offset"] == at.get(p["sequence_id"], 0)
        at[p["sequence_id"]] = p["offset"] + p["length"]
    for i, whole in ids.items():
        mine = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == i)
        assert sum(n for _, n in mine) == len(whole) and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:], strict=False))
    assert sorted(at) == list(range(len(at))) and all(n == 1024 for n in list(at.values())[:-1])


def test_op5(spark, folder, rows):
    want = brute.near_duplicates([(i, t) for i, t, _ in rows[0]], 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, folder, "op5_minhash_near_dedup")} == want
    assert len({c for _, c in want.values()}) < len(want) - 15


def test_op6(spark, folder, rows):
    ids = _cut(spark, rows[0], "op6", "word_bpe_49k.json", 1)
    start = 0
    got = {r["doc_id"]: r for r in run(spark, folder, "op6_token_files")}
    for i in sorted(ids):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids[i]), brute.crc(ids[i]))
        start += len(ids[i])


def test_op7(spark, folder):
    got = {r["page_id"]: r["text"] for r in run(spark, folder, "op7_html_text")}
    assert got == {i: "" if not h else " ".join(h.removeprefix("<p>").removeprefix("<b>").split()) for i, _, h in folder[1]}


def test_op8(spark, folder, rows):
    want = {(i, n, g, brute.digest(k)) for i, n, g, k in brute.remove_repeats([(i, t) for i, t, _ in rows[0]], 13)}
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run(spark, folder, "op8_substring_dedup")} == want


def test_op9(spark, folder):
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in folder[2]]
    want = brute.top_k(single, lambda i: i % 20 == 0, 20, 64.0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in run(spark, folder, "op9_exact_topk")) == sorted(want)


def test_op10(spark, folder):
    first, want = {}, []
    for i, _, h in sorted(folder[1], key=lambda p: p[0]):
        raw = (h or "").encode()
        home = first.setdefault(raw, i) if len(raw) >= 100 else i
        want.append((i, len(raw), sha256(raw).hexdigest(), "response" if home == i else "revisit", None if home == i else home))
    assert sorted(map(str, (tuple(r.values()) for r in run(spark, folder, "op10_warc")))) == sorted(map(str, want))


# A plain version of the language classifier: counts in dictionaries, one n-gram at a time.


def grams(text):
    fold = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in f" {text} ".encode()]
    for n in (1, 2, 3):
        for k in range(len(fold) - n + 1):
            g = fold[k : k + n]
            if n > 1 and g[0] == 32 and g[-1] == 32:
                continue
            value = 0
            for b in g:
                value = value * 256 + b
            yield n, (((value * 2654435761) % 2**32 + n) % 2**32) >> 16


def plain_classifier(labelled):
    langs = sorted({lang for _, _, lang in labelled})
    count = {lang: {} for lang in langs}
    for _, t, lang in labelled:
        for g in grams(t):
            count[lang][g] = count[lang].get(g, 0) + 1
    total = {(lang, n): sum(c for (m, _), c in count[lang].items() if m == n) for lang in langs for n in (1, 2, 3)}
    code = langid.codewords(len(langs))

    def weight(g, b):
        floor = 0.5 / max(total[lang, g[0]] for lang in langs)
        share = [count[lang].get(g, 0) / max(1, total[lang, g[0]]) for lang in langs]
        one, zero = ([s for s, c in zip(share, code[:, b], strict=True) if c == side] for side in (1, -1))
        return np.float32(math.log((sum(one) / len(one) + floor) / (sum(zero) / len(zero) + floor)))

    known = {}

    def margins(text):
        found = list(grams(text))
        for g in found:
            if g not in known:
                known[g] = [float(weight(g, b)) for b in range(code.shape[1])]
        return [sum(known[g][b] for g in found) * 60 / (len(found) + 60) for b in range(code.shape[1])]

    trust = []
    for k, lang in enumerate(langs):
        z = [margins(t) for _, t, x in labelled if x == lang]
        trust.append([(sum(m[b] * code[k, b] > 0 for m in z) + 1) / (len(z) + 2) for b in range(code.shape[1])])
    trust = [[t / sum(row) for t in row] for row in trust]

    def predict(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        z = margins(text)
        far = [sum(t * math.log1p(math.exp(-m * c)) if m * c > -30 else t * -m * c for t, m, c in zip(trust[k], z, code[k], strict=True)) for k in range(len(langs))]
        return langs[int(np.argmin(far))], 1 / sum(math.exp(min(far) - f) for f in far)

    return predict


def test_op2(spark, folder, rows):
    out = {i for i, _, _ in rows[0] if zlib.crc32(str(i).encode()) % 5 == 0}
    predict = plain_classifier([r for r in rows[0] if r[0] not in out and r[1] and r[2]])
    got = {r["doc_id"]: r for r in run(spark, folder, "op2_language_id")}
    assert {i for i, r in got.items() if r["held_out"]} == out and len(got) == len(rows[0])
    for i, t, _ in rows[0]:
        lang, score = predict(t)
        assert got[i]["score"] == pytest.approx(score, abs=2e-3), i
        assert got[i]["lang_pred"] == lang or 0 < score < 0.502, i  # half one language, half another: rounding decides


def test_pipeline(spark, folder, rows):
    out = {i for i, _, _ in rows[0] if zlib.crc32(str(i).encode()) % 5 == 0}
    predict = plain_classifier([r for r in rows[0] if r[0] not in out and r[1] and r[2]])
    kept = [(i, t) for i, t, _ in rows[0] if predict(t)[1] >= langid.SURE]
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder[0])
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            docs.write.parquet(f"{folder[0]}/after-{name}")
            docs = spark.read.parquet(f"{folder[0]}/after-{name}")
            seen.append(sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect()))
    want = [kept]
    component = brute.near_duplicates(kept, 80)
    want.append([(i, t) for i, t in kept if component[i][1] == i])
    cut = {i: (n, gone) for i, n, gone, _ in brute.remove_repeats(want[-1], 50)}
    whole = {i: [w for w in k] for i, _, _, k in brute.remove_repeats(want[-1], 50)}
    want.append([(i, t if cut[i][1] == 0 else whole[i]) for i, t in want[-1] if cut[i][0] > cut[i][1] or cut[i][1] == 0])
    texts = [t if isinstance(t, str) else " ".join(t) for _, t in want[-1]]
    bad = {d for d, _ in brute.find_items(texts, [(1, rows[1]), (2, "nowhere at all in any of these texts here")])}
    want.append([x for k, x in enumerate(want[-1]) if k not in bad])
    for have, need in zip(seen, want, strict=True):
        assert [(i, t.split()) for i, t, _ in have] == [(i, t.split() if isinstance(t, str) else t) for i, t in sorted(need, key=lambda x: x[0])]
        assert all(n == len(t) for _, t, n in have)
    assert len(want[0]) < len(rows[0]) and len(want[1]) < len(want[0]) and len(want[3]) < len(want[2]) and any(not isinstance(t, str) for _, t in want[2])
    ids = {i: len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in seen[-1]}
    have = {}
    for r in docs.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert have == ids
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder[0]).select("doc_id").distinct().collect()) == sorted(ids)


def scratch(spark):
    from veriscope.llm.common import checkpoint_root

    return {p.name for p in Path(checkpoint_root(spark).removeprefix("file://"), "veriscope").glob("*")}


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("none", []), ("odd", [(None, "plain words of one language here", "aa", None, None), (1, None, None, "s", 0), (1, "", "aa", "s", 0), (2, "zq zq zq zq", "bb", "s", 11), (2, "zq zq zq zq", "bb", "s", 11)])):
        at = f"file://{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        before = scratch(spark)
        made = corpus_pipeline.run(spark, at)
        assert len(scratch(spark) - before) <= 2  # what the last stage reads, and its own table of ids
        got = made.collect()
        assert bool(got) == bool(data)
        assert all(json.dumps(r.asDict()) for r in got) and all(r.doc_id in (None, 2) for r in got)
