import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from veriscope.llm import coder, packing, tokenfile
from veriscope.llm.common import open_fs
from veriscope.llm.tokenize import encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", "a", " x\n\ny ", "<|endoftext|> it", "don't WE'LL  'S", "日本語 text", "é é ﬁ İ ı ǅ", "1234 56.7%%% a&&&", "  x", "\x00\x1f", "ſ K Å", "a​b", "x" * 3000, "ÀÉ ñ ß-ü", "\r\n\t\x0b\x0c"]


def plain(path, texts):
    tok = Tokenizer.from_file(path)
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(name, corpus):
    path = public_tokenizers.path(name)
    texts = ODD + [t for _, t in corpus]
    enc = encoder(path)
    got = [np.frombuffer(b, dtype=enc.dtype).tolist() for b in enc.encode(texts)]
    assert got == plain(path, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n'sStTABé½²ß́-9"))), max_size=6))
def test_ids_equal_the_library_on_any_text(texts):
    for name in FILES:
        path = public_tokenizers.path(name)
        enc = encoder(path)
        assert [np.frombuffer(b, dtype=enc.dtype).tolist() for b in enc.encode(texts)] == plain(path, texts)


def test_packing(documents, corpus):
    path = public_tokenizers.path(FILES[0])
    ids = {i: x + [0] for (i, _), x in zip(corpus, plain(path, [t for _, t in corpus]), strict=True)}
    pieces = packing.pack(documents, path, with_ids=True)
    rows = pieces.collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(by.setdefault(r.doc_id, [])) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == brute.crc(r.ids) and r.length == len(r.ids) <= 1024
        by[r.doc_id] += r.ids
    assert by == ids
    total, seqs = sum(map(len, ids.values())), {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == len(seqs.setdefault(r.sequence_id, []))
        seqs[r.sequence_id] += r.ids
    assert sorted(seqs) == list(range(-(-total // 1024))) and all(len(s) == 1024 for k, s in seqs.items() if k != max(seqs))
    for r in packing.sequences(pieces).collect():
        own = seqs[r.sequence_id]
        exact = len(own) & (len(own) - 1) == 0
        assert r.ids == own + [0] * (0 if exact else 1024 - len(own))
        assert [b.offset for b in r.boundaries] == sorted(x.offset for x in rows if x.sequence_id == r.sequence_id)


def test_packing_pads_all_but_powers_of_two(spark, nothing):
    path = public_tokenizers.path(FILES[0])
    for n, want in ((63, 64), (64, 1024), (0, 1)):
        df = spark.createDataFrame([(1, " a" * n)], "doc_id long, text string")
        assert len(packing.sequences(packing.pack(df, path, with_ids=True)).first().ids) == want
    assert packing.pack(nothing, path).count() == 0


def test_packing_nulls_and_repeats(spark):
    path = public_tokenizers.path(FILES[0])
    df = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as part")
    rows = sorted((r.sequence_id, r.offset, r.length) for r in packing.pack(df, path).collect())
    assert rows == [(0, 0, 1), (0, 1, 1), (0, 2, 1)]


def there_and_back(spark, blocks, width):
    """(coded bytes, ids) of blocks."""
    kind = "<u2" if width == 2 else "<u4"
    rows = [(k, bytearray(np.asarray(b, dtype=kind).tobytes()), len(b)) for k, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "k int, ids binary, n int").withColumn("data", coder.encoded(spark, F.col("ids"), width))
    got = df.select("k", "data", coder.decoded(spark, F.col("data"), F.col("n"), F.lit(width)).alias("back")).orderBy("k").collect()
    return [bytes(r.data) for r in got], [np.frombuffer(bytes(r.back), dtype=kind) for r in got]


@pytest.mark.parametrize("width", [2, 4])
def test_coder_round_trip(spark, width):
    rng = np.random.default_rng(width)
    most = 1 << (8 * width)
    blocks = [rng.integers(0, high, n) for high in (1, 2, 4, 300, 50_000, most) for n in (0, 1, 2, 5, 300, 4096)]
    blocks += [np.full(4096, most - 1), np.arange(4096), np.tile([1, 2, 3, 2], 1024), np.tile(np.arange(700), 6)[:4096]]
    words = rng.integers(0, 50_000, (40, 3))
    blocks += [np.concatenate([words[k] for k in rng.integers(0, 40, 1300)])[:4096] for _ in range(30)]
    data, back = there_and_back(spark, blocks, width)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back, strict=True))
    assert len(data[-1]) < 4096  # two bytes an id and more, plain
    assert all(len(d) <= 8 + len(b) * (width + 1) for d, b in zip(data, blocks, strict=True))


def test_coder_on_any_short_block(spark):
    rng = np.random.default_rng(0)
    blocks = [rng.choice([0, 1, 2, 65_535, 40_000], int(rng.integers(0, 40)), p=[0.5, 0.2, 0.1, 0.1, 0.1]) for _ in range(3000)]
    _, back = there_and_back(spark, blocks, 2)
    assert all(a.tolist() == b.tolist() for a, b in zip(blocks, back, strict=True))


def test_damaged_bytes_decode_to_something(spark):
    rng = np.random.default_rng(1)
    data, _ = there_and_back(spark, [rng.integers(0, 500, 400) for _ in range(40)], 2)
    rows = []
    for d in data:
        for cut in (d[: len(d) // 2], b"", bytes(rng.integers(0, 256, len(d), dtype=np.uint8)), d[:3] + b"\xff" * 40 + d[43:]):
            rows.append((bytearray(cut),))
    df = spark.createDataFrame(rows, "data binary")
    got = df.select(F.octet_length(coder.decoded(spark, F.col("data"), F.lit(400), F.lit(2))).alias("n")).collect()
    assert {r.n for r in got} <= {0, 800}


def test_token_files(documents, corpus):
    path = public_tokenizers.path(FILES[1])
    ids = {i: x + [1] for (i, _), x in zip(corpus, plain(path, [t for _, t in corpus]), strict=True)}
    files = tokenfile.write(documents, path)
    start, want = 0, {}
    for i in sorted(ids):
        want[i] = (start, len(ids[i]), brute.crc(ids[i]), ids[i])
        start += len(ids[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, r.ids) for r in files.read(with_ids=True).collect()} == want
    # a damaged block is found out
    name = files.manifest.first()["file"]
    fs, base = open_fs(files.path)
    with fs.open_input_file(f"{base}/{name}") as f:
        raw = bytearray(f.read())
        spans = tokenfile.directory(f)["blocks"]
    raw[spans[0][0] + 1] ^= 4
    with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(bytes(raw))
    with pytest.raises(Exception, match="damaged block"):
        files.read().collect()
    raw[-30] ^= 4
    with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(bytes(raw))
    with pytest.raises(Exception, match="damaged directory"):
        files.read().collect()


def test_spans_are_read_by_block(documents, corpus):
    path = public_tokenizers.path(FILES[1])
    every = [x for i in sorted(i for i, _ in corpus) for x in [*plain(path, [dict(corpus)[i]])[0], 1]]
    files = tokenfile.write(documents, path)
    for first, last in ((0, 1), (5, 9000), (len(every) - 3, len(every)), (4096, 8192), (len(every), len(every) + 5)):
        got = sorted(files.span(first, last).collect())
        assert [x for r in got for x in r.ids] == every[first:last]
        assert all(every[r.start : r.start + len(r.ids)] == r.ids for r in got)


def test_token_files_nulls_repeats_and_nothing(spark, nothing):
    path = public_tokenizers.path(FILES[1])
    df = spark.createDataFrame([(2, "b"), (None, "a"), (2, "b"), (1, None), (3, "")], "doc_id long, text string").selectExpr("*", "1 as h", "2 as part")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfile.write(df, path).read().collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, 2, 2), (5, 2, 2), (7, 3, 1)]
    assert tokenfile.write(nothing, path).read().count() == 0
