"""Language identification by error-correcting output codes over byte n-grams.

Every language of the training rows gets a codeword; a binary classifier for
each bit tells the languages with a one from those with a zero by the log
ratio of their hashed n-gram frequencies.  Decoding is loss-weighted: a
codeword's distance is the logistic loss of the bits' margins, each weighted by
how often that bit was right for that language on the training rows.  The
nearest codeword wins; where the runner-up is close, the row is ambiguous.

The classifiers are fitted on at most ``per_language`` labelled rows of each
language, those of least hash, repeated rows once.  Whole texts are used, there and in
prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from .common import carried, column, materialise, restored, text_chunks, with_fields

UNKNOWN = "und"
#: Labelled rows of a language that the fit takes.
PER_LANGUAGE = 4000
ORDERS, SLOTS = (1, 2, 3), 1 << 16
#: n-grams after which more text adds no certainty; a score below which a row is ambiguous.
EVIDENCE, SURE = 60.0, 0.75
#: Bytes of text whose n-grams a task holds at once.
SLICE = 1 << 19
_LETTERS = re.compile(r"[^\W\d_]+")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32
_FOLD[[*range(91, 97), *range(123, 128)]] = 32


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for m in _LETTERS.finditer(text) for c in m[0])


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A code of +1 and -1, a row a language, columns neither constant, equal nor opposite.

    All such columns for up to five languages; for more, ten times log2(n)
    columns, of a few hundred random choices the one whose closest rows are
    farthest apart.
    """
    if n < 2:
        return np.ones((n, 0), dtype=np.int8)
    if n <= 5:
        bits = np.arange(1, 1 << (n - 1))
        return np.where((bits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.int8)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(300):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (n, width))
        if (np.abs(code.sum(axis=0, dtype=np.int64)) == n).any():
            continue
        apart = (width - code.astype(np.int64) @ code.T) // 2
        least = int((apart + width * np.eye(n, dtype=np.int64)).min())
        if least > far:
            best, far = code, least
    return best


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every n-gram, its text): bytes in lower case, all but letters a space."""
    raw = [b" " if not t else b" " + t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    buf = _FOLD[np.frombuffer(b"".join(raw), dtype=np.uint8)].astype(np.uint32)
    own = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) for r in raw])
    slots, owners = [], []
    key = buf
    for n in ORDERS:
        if n > 1:
            key = (key[:-1] << np.uint32(8)) | buf[n - 1 :]
        inside = own[: len(key)] == own[n - 1 :]
        # of blanks in a row only one speaks
        inside &= ~((buf[: len(key)] == 32) & (buf[n - 1 :] == 32)) | (n == 1)
        h = (key[inside] * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(16)
        slots.append(h.astype(np.int64) + (n - 1) * SLOTS)
        owners.append(own[: len(key)][inside])
    return np.concatenate(slots), np.concatenate(owners)


@dataclass
class Model:
    """What the driver fits and tasks share: bounded by slots and bits, whatever the corpus."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Log ratio of each bit for each text, levelled off at ``EVIDENCE`` n-grams."""
        total = np.zeros((len(texts), self.code.shape[1]))
        count = np.zeros(len(texts))
        slots, own = features(texts)
        for k in range(0, len(slots), 1 << 18):
            s, o = slots[k : k + (1 << 18)], own[k : k + (1 << 18)]
            first = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
            # a text has a run for each order, and may have several here
            np.add.at(total, o[first], np.add.reduceat(self.weights[s], first, axis=0))
            np.add.at(count, o[first], np.diff(np.append(first, len(o))))
        return total * (EVIDENCE / (count + EVIDENCE))[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, list[str | None]]:
        """(language, score, ambiguous, runner-up) of each text."""
        n = len(texts)
        some = np.array([has_letter(t) for t in texts], dtype=bool)
        names, score = [UNKNOWN] * n, np.zeros(n)
        ambiguous, second = ~some, [None] * n
        if not self.languages:
            return names, score, np.ones(n, dtype=bool), second
        rows = np.flatnonzero(some)
        if len(self.languages) == 1:
            score[rows] = 1.0
            for i in rows:
                names[i] = self.languages[0]
            return names, score, ambiguous, second
        if len(rows):
            z = self.margins([texts[i] for i in rows])
            loss = np.logaddexp(0, -z[:, None, :] * self.code[None])
            far = (loss * self.trust[None]).sum(axis=2)
            order = np.argsort(far, axis=1, kind="stable")
            near = np.exp(far.min(axis=1, keepdims=True) - far)
            score[rows] = 1 / near.sum(axis=1)
            ambiguous[rows] = score[rows] < SURE
            for i, (a, b) in zip(rows.tolist(), order[:, :2].tolist(), strict=True):
                names[i], second[i] = self.languages[a], self.languages[b]
        return names, score, ambiguous, second


def _bits(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A weight for each slot and bit from n-gram counts (languages x slots); each language weighs alike."""
    out = np.zeros((counts.shape[1], code.shape[1]), dtype=np.float32)
    for n in range(len(ORDERS)):
        part = slice(n * SLOTS, (n + 1) * SLOTS)
        c = counts[:, part]
        share = c / np.maximum(1, c.sum(axis=1, keepdims=True))
        floor = 0.5 / c.sum(axis=1).max(initial=1)
        for b in range(code.shape[1]):
            one, zero = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
            out[part, b] = np.log((one + floor) / (zero + floor))
    return out


def fit(spark: SparkSession, labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from ``labelled`` (doc_id, text, lang); rows without a language or text are left out.

    The driver gets sums by language and slot, and a row a language.
    """
    known = labelled.where("lang is not null and text is not null")
    # a threshold on the hash keeps about twice the rows that are wanted; only those move
    shares = [(r["lang"], min(1.0, 2 * per_language / r["count"])) for r in known.groupBy("lang").count().collect()]
    least = F.create_map(*[F.lit(x) for lang, share in shares for x in (lang, int(share * (1 << 32)))])
    hashed = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")) if shares else known.select("lang", "text", F.lit(0).cast("long").alias("h"))
    near = hashed.where(F.pmod("h", F.lit(1 << 32)) < least[F.col("lang")]) if shares else hashed
    pick = Window.partitionBy("lang").orderBy("h")
    sample = near.dropDuplicates(["lang", "h"]).withColumn("r", F.row_number().over(pick)).where(F.col("r") <= per_language)
    sample = materialise(sample.select("lang", "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in text_chunks(batches, limit=SLICE):
            slots, own = features(batch.column("text").to_pylist())
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                mine = (langs == lang)[own]
                have = sums.setdefault(lang, np.zeros(len(ORDERS) * SLOTS, dtype=np.int64))
                have += np.bincount(slots[mine], minlength=len(have))
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(have[at])], names=["lang", "slot", "n"])

    summed = sample.coalesce(8).mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(summed.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(langs.tolist()))
    counts = np.zeros((len(languages), len(ORDERS) * SLOTS))
    row = {lang: i for i, lang in enumerate(languages)}
    counts[[row[x] for x in langs], summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
    code = codewords(len(languages))
    model = Model(languages, code, _bits(counts, code), np.ones(code.shape))
    if code.shape[1]:
        right = _right(spark, sample, model)
        trust = np.array([[(right[x][0][b] + 1) / (right[x][1] + 2) for b in range(code.shape[1])] for x in languages])
        model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def _right(spark: SparkSession, sample: DataFrame, model: Model) -> dict[str, tuple[list[int], int]]:
    """How often each bit is right on the rows of each language, and their number."""
    shared, width = spark.sparkContext.broadcast(model), model.code.shape[1]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        row = {x: i for i, x in enumerate(m.languages)}
        for batch in text_chunks(batches, limit=SLICE):
            langs = batch.column("lang").to_pylist()
            ok = m.margins(batch.column("text").to_pylist()) * m.code[[row[x] for x in langs]] > 0
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(list(ok.astype(np.int64)), pa.list_(pa.int64()))], names=["lang", "ok"])

    sums = [F.sum(F.col("ok")[b]).alias(f"b{b}") for b in range(width)]
    rows = sample.coalesce(8).mapInArrow(judge, "lang string, ok array<long>").groupBy("lang").agg(F.count("*").alias("n"), *sums).collect()
    return {r["lang"]: ([r[f"b{b}"] for b in range(width)], r["n"]) for r in rows}


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``ambiguous`` and ``lang_second``.

    Only ``text_col`` is looked at.  Null texts and texts without a letter are
    ``und`` with score 0 and ambiguous; so is every text if the model has no
    language.  Columns that bear those four names already are replaced; all
    rows stay.
    """
    made = ("lang_pred", "score", "ambiguous", "lang_second")
    names, cols = carried(docs, *made)
    plain = docs.select(*cols, column(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, limit=SLICE):
            lang, score, ambiguous, second = shared.value.predict(batch.column("text").to_pylist())
            new = [pa.array(lang), pa.array(score), pa.array(ambiguous), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *made])

    types = StringType(), DoubleType(), BooleanType(), StringType()
    out = plain.mapInArrow(run, with_fields(plain.drop("text"), *[StructField(n, t) for n, t in zip(made, types, strict=True)]))
    return out.select(*restored(names), *made)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows that the fit leaves out: crc32 of the id as text is a multiple of ``folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
