"""Rankings as relations: dense, lexical, fusion, caps, reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.text import STOP_WORDS

#: Bytes of query vectors, rows of query terms and bytes of evidence that are broadcast at once.
QUERY_BYTES, QUERY_TERMS, ITEM_BYTES = 64 << 20, 1_000_000, 64 << 20
#: Vectors, and questions, that meet at once; numbers in a table of scores, words and matches at once, rows that wait to be ranked.
_BLOCK, _ASKED, _CELLS, _WORDS, _WAITING = 4096, 512, 1 << 20, 1 << 18, 1 << 16
#: Scores that are rounded to 9 digits may come to lie this much apart from what they were, and be equal.
_NEAR = 2e-9


def ranked(rows: DataFrame, k: int | None = None, by: str = "score", question: str = "question_id", item: str = "chunk_id") -> DataFrame:
    """``rows`` with ``rank`` by falling ``by``, nulls last, ties by item; at most ``k`` a question."""
    order = Window.partitionBy(question).orderBy(F.col(by).desc_nulls_last(), F.col(item))
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def dense(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(question_id, chunk_id, score, rank): exact cosine top ``k``.

    ``queries`` (question_id, vector) meet ``vectors`` (chunk_id, vector) in
    blocks: slices of the queries of a bounded size are broadcast, each task
    keeps its best ``k`` for each query, and those meet in a window.  A row
    never meets itself if the ids are equal.  Ties to 9 digits go to the
    smaller id; null vectors and those of another length take no part.
    """
    asked = queries.where("vector is not null").select("question_id", F.col("vector").cast("array<double>").alias("vector"))
    size = asked.agg(F.sum(F.size("vector") * 8 + 8)).first()[0] or 0
    slices = max(1, -(-size // QUERY_BYTES))
    out = None
    for part in range(slices):
        rows = asked.where(F.pmod(F.xxhash64("question_id"), F.lit(slices)) == part).toArrow().combine_chunks()
        ids, lists = (rows.column(c).combine_chunks() for c in ("question_id", "vector"))
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        blocks = {int(d): (ids.to_numpy()[lengths == d], _unit(_matrix(lists.filter(pa.array(lengths == d)), d))) for d in np.unique(lengths)}
        shared = queries.sparkSession.sparkContext.broadcast(blocks)
        found = vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null").mapInArrow(
            lambda it, shared=shared: _best(it, shared.value, k), "question_id long, chunk_id long, score double"
        )
        out = found if out is None else out.unionByName(found)
    return ranked(out, k)


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    """Lists of ``d`` numbers as rows; null is not a number."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), d)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)


def _candidates(score: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of scores, before rounding, that may be among a row's best ``k`` or above its ``least``."""
    if score.shape[1] > k and np.isneginf(least).any():  # once a task, mostly
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]  # what is not a number comes last
        least = np.fmax(least, kth)
    return np.nonzero(score >= least[:, None] - _NEAR)


def _best(batches: Iterator[pa.RecordBatch], blocks: dict, k: int) -> Iterator[pa.RecordBatch]:
    """Each query's best ``k`` of a task; ``_ASKED`` queries meet ``_BLOCK`` vectors at once, so memory holds those and the best."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        lists, ids = batch.column("vector"), batch.column("chunk_id").to_numpy()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        for d, (q_ids, q) in blocks.items():
            mine = np.flatnonzero(lengths == d)
            for at in range(0, len(mine), _BLOCK):
                pick = mine[at : at + _BLOCK]
                v, near = _unit(_matrix(lists.take(pa.array(pick)), d)).T, ids[pick]
                own = np.isin(near, q_ids).any()
                for first in range(0, len(q_ids), _ASKED):
                    some = slice(first, first + _ASKED)
                    score = q[some] @ v
                    if own:
                        score[q_ids[some, None] == near[None, :]] = np.nan
                    now = held.setdefault((d, first), [(), np.full(len(score), -np.inf)])
                    row, col = _candidates(score, now[1], k)
                    if len(row):
                        held[d, first] = _kept(now[0], (row, near[col], np.round(score[row, col], 9)), len(score), k)
    for (d, first), (rows, _) in held.items():
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(blocks[d][0][first + rows[0]]), pa.array(rows[1]), pa.array(rows[2])], names=["question_id", "chunk_id", "score"])


def _kept(old: tuple, new: tuple, queries: int, k: int) -> list:
    """The best ``k`` of each query among rows (query, chunk, score), and the least score of queries that have so many."""
    both = tuple(np.concatenate(x) for x in zip(old, new, strict=True)) if old else new
    order = np.lexsort((both[1], -both[2], both[0]))
    row = both[0][order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    least = np.full(queries, -np.inf)
    least[row[place == k - 1]] = both[2][order[place == k - 1]]
    return [tuple(x[order[place < k]] for x in both), least]


def words(text: Column) -> Column:
    """Words ``[a-z0-9]+``, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def terms(text: Column) -> Column:
    """:func:`words` but stop words."""
    return F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS))


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf) of ``chunks`` (chunk_id, text)."""
    return chunks.select("chunk_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


@dataclass
class _Questions:
    """Questions by number, the terms that they ask for, and each term's questions as a span of ``asked``."""

    ids: pa.Array
    terms: pa.Array
    starts: np.ndarray
    asked: np.ndarray


def _questions(rows: pa.Table) -> _Questions:
    """Questions from rows (question_id, term)."""
    ids, terms = (rows.column(c).combine_chunks().dictionary_encode() for c in ("question_id", "term"))
    term = terms.indices.to_numpy()
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms.dictionary)))])
    return _Questions(ids.dictionary, terms.dictionary, starts, ids.indices.to_numpy()[np.argsort(term, kind="stable")].astype(np.int64))


def _best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Of a table (rows by rising id, questions), the places of each question's ``k`` best above 0, ties to the first."""
    if len(scores) <= k:
        return scores > 0
    least = -np.partition(-scores, k - 1, axis=0)[k - 1]
    tie = scores == least
    return (scores > 0) & ((scores > least) | (tie & (np.cumsum(tie, axis=0) <= k - (scores > least).sum(axis=0))))


class _Best:
    """The ``k`` best rows (q, score, chunk_id) of each question so far; new rows wait until they are as many as those held."""

    def __init__(self, questions: int, k: int):
        self.k, self.held, self.waiting, self.n = k, None, [], 0
        self.least, self.last = np.zeros(questions), None

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of some rows, by rising id, for all questions."""
        pick = (scores > 0) & (scores >= self.least)
        if self.last is not None:
            pick &= (scores > self.least) | (ids.to_numpy(zero_copy_only=False)[:, None] < self.last)
        if np.count_nonzero(pick) > _BLOCK:
            pick &= _best_rows(scores, self.k)
        i, q = np.nonzero(pick)
        self.waiting.append(pa.table({"q": q, "score": scores[i, q], "chunk_id": ids.take(pa.array(i))}))
        self.n += len(q)
        if self.n > max(_WAITING, 0 if self.held is None else self.held.num_rows):
            self.rows()

    def rows(self) -> pa.Table | None:
        if self.waiting:
            both = pa.concat_tables([*([] if self.held is None else [self.held]), *self.waiting])
            both = both.sort_by([("q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
            q = both.column("q").to_numpy()
            place = np.arange(len(q)) - np.searchsorted(q, q)
            full = place == self.k - 1
            self.least[q[full]] = both.column("score").to_numpy()[full]
            if pa.types.is_integer(both.schema.field("chunk_id").type):
                self.last = np.full(len(self.least), np.iinfo(np.int64).max)
                self.last[q[full]] = both.column("chunk_id").to_numpy()[full]
            self.held, self.waiting, self.n = both.filter(pa.array(place < self.k)).combine_chunks(), [], 0
        return self.held


def _spans(sizes: np.ndarray, most: int, rows: int) -> Iterator[slice]:
    """Rows in spans of at most ``rows`` whose ``sizes`` sum to ``most``, or one that is larger."""
    upto, first = np.concatenate([[0], np.cumsum(sizes)]), 0
    while first < len(sizes):
        last = min(first + rows, max(first + 1, int(np.searchsorted(upto, upto[first] + most, side="right")) - 1))
        yield slice(first, last)
        first = last


def _scored(batches: Iterator[pa.RecordBatch], asked: _Questions, runs: list[bool], k: int) -> Iterator[pa.RecordBatch]:
    """(run, question_id, chunk_id, score): the ``k`` best of a task for each question; a run counts different terms or all.

    A term that stands in a row is added to the questions that ask for it, so
    work follows the matches; memory is bounded by spans of rows.
    """
    n, span = len(asked.ids), np.diff(asked.starts)
    if not n:
        return
    best = [_Best(n, k) for _ in runs]
    for whole in batches:
        order = pc.sort_indices(whole.column("chunk_id"))
        lengths = pc.list_value_length(whole.column("terms")).fill_null(0).to_numpy(zero_copy_only=False)[order.to_numpy()]
        for words in _spans(lengths, _WORDS, len(lengths)):
            batch = whole.take(order[words])
            lists, ids = batch.column("terms"), batch.column("chunk_id")
            term = pc.index_in(lists.flatten(), value_set=asked.terms)
            known = term.is_valid().to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)[known]
            cell, count = np.unique(row * len(span) + term.drop_null().to_numpy(), return_counts=True)
            row, term = np.divmod(cell, len(span))
            work = np.bincount(row, weights=span[term], minlength=len(ids)).astype(np.int64)
            for part in _spans(work, _WORDS, max(1, _CELLS // n)):
                some = slice(*np.searchsorted(row, [part.start, part.stop]))
                times, tf = span[term[some]], count[some].astype(np.float64)
                ends = np.cumsum(times)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(asked.starts[term[some]] - ends + times, times)
                place = np.repeat((row[some] - part.start) * n, times) + asked.asked[at]
                for run, different in enumerate(runs):
                    weights = None if different else np.repeat(tf, times)
                    scores = np.bincount(place, weights=weights, minlength=(part.stop - part.start) * n).reshape(-1, n).astype(np.float64, copy=False)
                    best[run].add(scores, ids.slice(part.start, part.stop - part.start))
    for run, found in enumerate(best):
        rows = found.rows()
        for part in rows.to_batches(max_chunksize=_BLOCK) if rows is not None else ():
            cols = [pa.repeat(pa.scalar(run, pa.int32()), part.num_rows), asked.ids.take(part.column("q")), part.column("chunk_id"), part.column("score")]
            yield pa.RecordBatch.from_arrays(cols, names=["run", "question_id", "chunk_id", "score"])


def lexical_runs(questions: DataFrame, chunks: DataFrame, k: int, scorings: list[str]) -> DataFrame:
    """(run, question_id, chunk_id, score, rank): the ranking of each scoring, all in one pass over the chunks.

    Terms of the questions are broadcast in slices of bounded size; a task
    counts them where chunks are read and keeps its best ``k`` a question, and
    those meet in a window.
    """
    asked = questions.select("question_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    slices = max(1, -(-asked.count() // QUERY_TERMS))
    # stop words are no question's, so they need not be left out here
    rows = chunks.select("chunk_id", words(F.col("text")).alias("terms"))
    schema = StructType([StructField("run", IntegerType()), asked.schema["question_id"], chunks.schema["chunk_id"], StructField("score", DoubleType())])
    different, found = [x == "distinct" for x in scorings], None
    for part in range(slices):
        shared = questions.sparkSession.sparkContext.broadcast(_questions(asked.where(F.pmod(F.xxhash64("question_id"), F.lit(slices)) == part).toArrow()))
        made = rows.mapInArrow(lambda it, shared=shared: _scored(it, shared.value, different, k), schema)
        found = made if found is None else found.unionByName(made)
    order = Window.partitionBy("run", "question_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical(questions: DataFrame, chunks: DataFrame, k: int, scoring: str = "occurrences", index: DataFrame | None = None) -> DataFrame:
    """(question_id, chunk_id, score, rank) by any of the question's terms.

    ``occurrences`` counts them all, ``distinct`` the different ones.  With an
    ``index`` (:func:`postings`) its rows are joined on the term.
    """
    if index is None:
        return lexical_runs(questions, chunks, k, [scoring]).drop("run")
    asked = questions.select("question_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    score = F.sum("tf") if scoring == "occurrences" else F.count("*")
    return ranked(index.join(asked, "term").groupBy("question_id", "chunk_id").agg(score.cast("double").alias("score")), k)


def fuse(runs: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (constant + rank), ties by first appearance in run order."""
    return fuse_rows(reduce(DataFrame.unionByName, (r.select(F.lit(i).alias("run"), "question_id", "chunk_id", "rank") for i, r in enumerate(runs))), k, constant)


def fuse_rows(both: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """:func:`fuse` of rankings in one relation, told apart by ``run``."""
    score = F.round(F.sum(1.0 / (constant + F.col("rank"))), 12)
    out = both.groupBy("question_id", "chunk_id").agg(score.alias("score"), F.min(F.struct("run", "rank")).alias("seen"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "seen", "chunk_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("seen")


def renumber(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))


def cap_per_document(ranking: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` chunks of a document, the best; ranks as they were."""
    order = Window.partitionBy("question_id", "document_id").orderBy("rank")
    return ranking.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cap).drop("__n")


def best_of_documents(ranking: DataFrame) -> DataFrame:
    """(question_id, document_id, rank): documents by their best chunk."""
    return renumber(ranking.groupBy("question_id", "document_id").agg(F.min("rank").alias("rank")))


def at_least(ranking: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return ranking.where(F.col(score) >= threshold)


def rerank(ranking: DataFrame, grades: DataFrame) -> DataFrame:
    """Order by ``grades`` (question_id, chunk_id, grade): graded ones first by falling grade, ties and the rest by rank."""
    out = ranking.join(grades.select("question_id", "chunk_id", "grade"), ["question_id", "chunk_id"], "left")
    order = Window.partitionBy("question_id").orderBy(F.col("grade").isNull(), F.col("grade").desc_nulls_last(), "rank")
    return out.withColumn("rank", F.row_number().over(order))


_AUTOMATA: dict[str, object] = {}


def _standing(batches: Iterator[pa.RecordBatch], key: str, items: dict[str, list[int]], ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """(item_id, doc_id) of texts that stand in a document, all looked for at once."""
    if key not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for text, places in items.items():
            made.add_word(text, places)
        made.make_automaton()
        _AUTOMATA[key] = made
    automaton = _AUTOMATA[key]
    for batch in batches:
        rows, found = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            if text and items:
                got = {p for _, places in automaton.iter(text) for p in places}
                rows += [i] * len(got)
                found += sorted(got)
        cols = [ids.take(pa.array(found, pa.int64())), batch.column("doc_id").take(pa.array(rows, pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["item_id", "doc_id"])


def evidence(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the item's text stands in the document's.

    Items are broadcast in slices of bounded size and all looked for in one
    pass over each document (Aho-Corasick); documents do not move.  Null and
    empty items stand nowhere.
    """
    plain = items.where("text <> ''").select("item_id", "text").distinct()
    size = plain.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    slices = max(1, -(-size // ITEM_BYTES))
    schema = StructType([items.schema["item_id"], documents.schema["doc_id"]])
    out = None
    for part in range(slices):
        rows = plain.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == part).toArrow()
        by: dict[str, list[int]] = {}
        for i, text in enumerate(rows.column("text").to_pylist()):
            by.setdefault(text, []).append(i)
        shared = documents.sparkSession.sparkContext.broadcast((uuid4().hex, by, rows.column("item_id").combine_chunks()))
        made = documents.select("doc_id", "text").mapInArrow(lambda it, shared=shared: _standing(it, *shared.value), schema)
        out = made if out is None else out.union(made)
    return out.distinct()


def pack_context(passages: DataFrame, most: int = 12_000) -> DataFrame:
    """(question_id, context, n_passages): numbered passages in rank order while their sum of characters fits."""
    block = passages.withColumn("block", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.trim("text")))
    run = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = block.withColumn("total", F.sum(F.length("block")).over(run)).where(F.col("total") <= most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    return kept.groupBy("question_id").agg(F.array_join(parts, "\n\n").alias("context"), F.count("*").alias("n_passages"))


def pool_statistics(pool: DataFrame, cap: int) -> DataFrame:
    """(question_id, n_pool, distinct_documents, dropped_by_cap) of a candidate pool."""
    per = pool.groupBy("question_id", "document_id").agg(F.count("*").alias("n"))
    return per.groupBy("question_id").agg(
        F.sum("n").alias("n_pool"), F.count("*").alias("distinct_documents"), F.sum(F.greatest(F.col("n") - cap, F.lit(0))).alias("dropped_by_cap")
    )
