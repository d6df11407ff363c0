"""Near-duplicate classes by an inverted join over MinHash signature coordinates.

Every document's set of word shingles gets a signature of minima.  A pair of
one of the first ``coordinates`` and its value is a token; documents are posted
under their tokens.  Two documents collide in as many coordinates as they share
minima; pairs of similarity ``threshold`` collide in ``match_threshold``
coordinates or more but for one in ten million.

Prefix: tokens of one document only are not posted.  A document with fewer
than ``match_threshold`` others can have no partner; any other is posted under
its rarest tokens only, as many as must meet at least one of any partner's.
Skip: of tokens with the same list of documents one is kept; within a list,
documents that are already connected are not compared again.

A posting carries no signature.  Collisions within a list are counted on a
sketch of each document: one byte of each of ``SKETCH`` coordinates, the posted
ones among them.  What is retained are the groups that collisions connect.
They are verified on full sets and links are joined to components.  No list of
all pairs is made.

A posting list or group beyond one block is cut into blocks; each is compared
within, and with a few pivots that meet every block.  That connects nearly all
of a group of copies.  Only rows left outside the largest tree so far are then
compared with all others of their list or group, so the work follows a group's
size and what does not belong to it, and no pair is missed.

Joins of two tables that both grow with the corpus are merge joins at every
size; none is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carried, column, connected_components, partitions, restored, text_chunks
from .words import distinct_sets, mix, shingles, split_words

#: Coordinates that are posted, and those that a sketch holds a byte of.
COORDINATES, SKETCH = 64, 192
#: Documents of a posting list, and of a verified group, that one task compares.
LIST_BLOCK, SET_BLOCK = 512, 256
#: Text of a verified block; rows of a divided list or group that meet all its blocks; text that is hashed at once.
SET_BYTES, PIVOTS, SLICE = 16 << 20, 8, 1 << 20
_U = np.uint64


def match_threshold(coordinates: int, percent: int, miss: float = 1e-7) -> int:
    """The most matches that a pair of the given similarity reaches but for a share of ``miss``."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return t
    return coordinates


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(1, 1 << 63, n, dtype=_U) | _U(1), rng.integers(0, 1 << 63, n, dtype=_U)


def signatures(h: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """Tokens (documents x coordinates) of sets that are not empty."""
    a, b = _coefficients(coordinates)
    out = np.empty((len(bounds) - 1, coordinates), dtype=_U)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(h * a[k] + b[k], bounds[:-1])
        out[:, k] = mix(out[:, k] + _U(k * 0x9E3779B97F4A7C15 % (1 << 64)))
    return out


def sketches(h: np.ndarray, bounds: np.ndarray, tokens: np.ndarray, size: int) -> np.ndarray:
    """A byte of each token, then of the minima of further coordinates of 32 bits, ``size`` bytes in all."""
    posted = tokens.shape[1]
    out = np.empty((len(tokens), max(size, posted)), dtype=np.uint8)
    out[:, :posted] = tokens.astype(np.uint8)
    half = (h >> _U(32)).astype(np.uint32)
    rng = np.random.default_rng(20_240_301)
    a, b = rng.integers(0, 1 << 32, (2, out.shape[1] - posted), dtype=np.uint32)
    for k in range(out.shape[1] - posted):
        least = np.minimum.reduceat(half * (a[k] | np.uint32(1)) + b[k], bounds[:-1])
        out[:, posted + k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set that is not empty, the same whatever the order."""
    one = np.add.reduceat(mix(h), bounds[:-1])
    two = np.bitwise_xor.reduceat(mix(h + _U(0x5851F42D4C957F2D)), bounds[:-1])
    return mix(mix(one) + two + np.diff(bounds).astype(_U))


def _sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, texts with a set, their hashes, their bounds)."""
    h, bounds = distinct_sets(*shingles(split_words(texts, lower=True)))
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    return n, some, h, np.append(bounds[some], len(h))


def signature_table(docs: DataFrame, coordinates: int, sketch: int = SKETCH) -> DataFrame:
    """(doc_id, th, n, vid, sig, sketch): vid names the class of documents with the same set; null without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, limit=SLICE):
            n, some, h, bounds = _sets(batch.column("text").to_pylist())
            vid, sig, short = np.zeros(len(n), dtype=np.int64), [None] * len(n), [None] * len(n)
            if len(some):
                vid[some] = set_keys(h, bounds).view(np.int64)
                tokens = signatures(h, bounds, coordinates)
                for i, s, t in zip(some.tolist(), tokens, sketches(h, bounds, tokens, sketch), strict=True):
                    sig[i], short[i] = s.tobytes(), t.tobytes()
            cols = [batch.column("doc_id"), batch.column("th"), pa.array(n.astype(np.int64)), pa.array(vid, mask=n == 0), pa.array(sig, pa.binary()), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n", "vid", "sig", "sketch"])

    return docs.mapInArrow(run, "doc_id long, th long, n long, vid long, sig binary, sketch binary")


def _tokens(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.int64)
                vid = np.repeat(batch.column("vid").to_numpy(), len(sig) // batch.num_rows)
                for k in range(0, len(sig), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(sig[k : k + (1 << 17)]), pa.array(vid[k : k + (1 << 17)])], names=["token", "vid"])

    return classes.select("vid", "sig").mapInArrow(run, "token long, vid long")


def _forest(near: np.ndarray) -> np.ndarray:
    """The tree of each row of the symmetric matrix ``near``, by number."""
    tree, n = np.full(len(near), -1), 0
    for k in range(len(near)):
        if tree[k] < 0:
            tree[k], todo = n, [k]
            while todo:
                got = np.flatnonzero(near[todo.pop()] & (tree < 0))
                tree[got] = n
                todo += got.tolist()
            n += 1
    return tree


def _collide(sketch: np.ndarray, least: int) -> np.ndarray:
    """The tree of each document, by number: documents that match in ``least`` coordinates; the connected are skipped."""
    tree, n, left = np.zeros(len(sketch), dtype=np.int64), 0, np.arange(len(sketch))
    while len(left):
        todo, left = [int(left[0])], left[1:]
        tree[todo] = n
        while todo and len(left):
            hit = (sketch[left] == sketch[todo.pop()]).sum(axis=1) >= least
            got, left = left[hit], left[~hit]
            tree[got] = n
            todo += got.tolist()
        n += 1
    return tree


def _least(values: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Of each row, the least value of its tree."""
    out = np.full(tree.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(out, tree, values)
    return out[tree]


class _Forest:
    """What a task's edges connect so far; an edge within a tree is not emitted again."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, v: int) -> int:
        up, r = self.up, v
        while (n := up.get(r, r)) != r:
            r = n
        while v != r:
            up[v], v = r, up.get(v, v)
        return r

    def connected(self, vid: list[int]) -> bool:
        first = self.root(vid[0])
        return all(self.root(v) == first for v in vid)

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)
        return a != b


#: A row at a block of its list or group; ``home`` at its own block, ``pivot`` if it meets all blocks.
_PLACED = ["i", "j", "m", "blocks", "home", "pivot"]
_FOUND = "a long, b long, key long, m long, blocks long"


def _batches(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(found, 65536)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=["a", "b", "key", "m", "blocks"])


def _first_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Each row at its block of the key's ``blocks``; about ``PIVOTS`` of the ``m`` rows of a divided key at every block."""
    own, zero = F.pmod(F.xxhash64("vid"), F.col("blocks")), F.lit(0).cast("long")
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("vid", key), F.col("m")) < PIVOTS)
    at = F.when(pivot, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array(own))
    rows = rows.select("vid", key, "m", "blocks", own.alias("own"), pivot.alias("pivot"), F.explode(at).alias("i"))
    return rows.select("vid", key, "i", zero.alias("j"), "m", "blocks", (F.col("i") == F.col("own")).alias("home"), "pivot")


def _rest_blocks(named: DataFrame, key: str) -> DataFrame:
    """Rows of divided keys that are not in the key's largest tree, with all rows of the key, in pairs of blocks.

    ``named`` (vid, tree, key, m, blocks) are the trees that the first blocks found in each key.
    """
    trees = named.groupBy(key, "tree").agg(F.count("*").alias("n"))
    largest = trees.groupBy(key).agg(F.max_by("tree", F.struct("n", "tree")).alias("top"), (F.sum("n") - F.max("n")).alias("left"))
    rows = named.join(largest.where("left > 0").hint("merge"), key).withColumn("out", F.col("tree") != F.col("top"))
    n_all, n_out = F.col("blocks"), F.ceil(F.col("left") * F.col("blocks") / F.col("m"))
    of_all, of_out = F.pmod(F.xxhash64("vid"), n_all), F.pmod(F.xxhash64("vid"), n_out)
    zero = F.lit(0).cast("long")

    def place(i: Column, j: Column) -> Column:
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))

    across = F.transform(F.sequence(zero, n_out - 1), lambda x: place(of_all, x))
    along = F.transform(F.sequence(zero, n_all - 1), lambda x: place(x, of_out))
    at = F.when(F.col("out"), F.array_union(across, along)).otherwise(across)
    rows = rows.select("vid", key, "m", F.explode(at).alias("p"))
    return rows.select("vid", key, "p.i", "p.j", "m", F.lit(1).cast("long").alias("blocks"), F.lit(False).alias("home"), F.lit(False).alias("pivot"))


def _links(key: int, rows: list[tuple], tree: np.ndarray, forest: _Forest | None = None) -> Iterator[tuple]:
    """Edges from each tree's smallest member, and of a divided key the tree of each row that is at home.

    ``rows`` are (vid, name, home, pivot, m, blocks); edges are between names.
    A tree of a divided key bears the name of its smallest pivot, the same in all blocks.
    """
    name = np.array([r[1] for r in rows], dtype=np.int64)
    for x, y in zip(_least(name, tree).tolist(), name.tolist(), strict=True):
        if x != y and (forest is None or forest.join(x, y)):
            yield x, y, None, None, None
    if rows[0][5] > 1:
        vid, none = np.array([r[0] for r in rows], dtype=np.int64), np.iinfo(np.int64).max
        pivot = _least(np.where([r[3] for r in rows], vid, none), tree)
        for (v, _, home, _, m, blocks), p in zip(rows, pivot.tolist(), strict=True):
            if home:
                yield v, v if p == none else p, key, m, blocks


def _components_of(rows: DataFrame, key: str, compare, scratch: Scratch, tag: str) -> DataFrame:
    """(node, root): what ``compare`` links of ``rows`` (vid, key, m, blocks), first by blocks, then what they leave."""
    found = scratch.keep(compare(_first_blocks(rows, key)), tag)
    edges = found.where("key is null").select("a", "b")
    named = found.where("key is not null").select(F.col("a").alias("vid"), F.col("b").alias("tree"), F.col("key").alias(key), "m", "blocks")
    if not named.isEmpty():
        more = scratch.keep(compare(_rest_blocks(named, key)), tag)
        edges = edges.union(more.select("a", "b"))
    return connected_components(edges, scratch)


def candidate_groups(classes: DataFrame, least: int, enough: int, scratch: Scratch) -> DataFrame:
    """(vid, tree): classes connected by sketches that match in ``enough`` bytes.

    ``least`` of the posted coordinates must match for a pair to be met.
    """
    tokens = _tokens(classes)
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(shared.hint("merge"), "token").groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    posted = ranked.where(F.size("t") >= least).select("vid", F.explode(F.slice("t", F.lit(1), F.size("t") - (least - 1))).alias("t"))
    posted = scratch.keep(posted.select("vid", "t.token"), "postings")
    lists = posted.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("vid")).alias("x"), F.min("vid").alias("v")).where("m > 1")
    lists = lists.groupBy("m", "x", "v").agg(F.min("token").alias("token"))
    blocks = F.ceil(F.col("m") / LIST_BLOCK).cast("long")
    kept = posted.join(lists.select("token", "m", blocks.alias("blocks")).hint("merge"), "token")
    sketched = classes.select("vid", "sketch")
    keys = ["token", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def link(key: tuple, rows: list[tuple], data: list[bytes]) -> Iterator[tuple]:
            divided = rows and rows[0][5] > 1
            if len(rows) > 1 and (divided or not forest.connected([r[0] for r in rows])):
                tree = _collide(np.frombuffer(b"".join(data), dtype=np.uint8).reshape(len(rows), -1), enough)
                yield from _links(key[0], rows, tree, forest)

        def found() -> Iterator[tuple]:
            now, rows, data = None, [], []
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("vid", "vid", "home", "pivot", "m", "blocks")]
                at = [batch.column(c).to_pylist() for c in keys]
                for key, row, s in zip(zip(*at, strict=True), zip(*cols, strict=True), batch.column("sketch").to_pylist(), strict=True):
                    if key != now:
                        yield from link(now, rows, data)
                        now, rows, data = key, [], []
                    rows.append(row)
                    data.append(s)
            yield from link(now, rows, data)

        return _batches(found())

    def compare(placed: DataFrame) -> DataFrame:
        rows = placed.join(sketched.hint("merge"), "vid")
        return rows.repartition(partitions(rows), *keys).sortWithinPartitions(*keys).mapInArrow(run, _FOUND)

    return _components_of(kept, "token", compare, scratch, "collisions").select(F.col("node").alias("vid"), F.col("root").alias("tree"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of a block of sets."""
    m = len(sets)
    if m == 2:
        out = np.diag([len(s) for s in sets]).astype(np.int64)
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    own = np.repeat(np.arange(m), [len(s) for s in sets])
    _, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[inv] > 1
    own, inv = own[often], inv[often]
    _, inv = np.unique(inv, return_inverse=True)
    out = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(inv, kind="stable")
    own, inv = own[order], inv[order]
    width = 4096
    for lo in range(0, int(inv[-1]) + 1 if len(inv) else 0, width):
        a, b = np.searchsorted(inv, [lo, lo + width])
        dense = np.zeros((m, width), dtype=np.float32)
        dense[own[a:b], inv[a:b] - lo] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def verified_links(docs: DataFrame, members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, root): linked documents of the candidate groups of ``members`` (doc_id, vid, tree), and the smallest each reaches."""
    texts = docs.select("doc_id", "text").join(members.withColumnRenamed("tree", "root").hint("merge"), "doc_id")
    texts = scratch.keep(texts.select("doc_id", "vid", "root", F.octet_length("text").cast("long").alias("size"), "text"), "texts")
    sized = texts.groupBy("root", "vid").agg(F.max("size").alias("size"))
    sizes = sized.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("size"))
    blocks = F.least(F.col("m"), F.greatest(F.ceil(F.col("m") / SET_BLOCK), F.ceil(F.col("size") / SET_BYTES)))
    rows = sized.select("root", "vid").join(sizes.select("root", "m", blocks.cast("long").alias("blocks")).hint("merge"), "root")
    keys = ["root", "i", "j"]

    def link(key: tuple, rows: dict[int, tuple], sets: dict[int, np.ndarray]) -> Iterator[tuple]:
        if len(sets) > 1:
            both = overlaps(list(sets.values()))
            n = np.array([len(x) for x in sets.values()], dtype=np.int64)
            yield from _links(key[0], list(rows.values()), _forest(100 * both >= percent * (n[:, None] + n[None, :] - both)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            now, rows, sets = None, {}, {}
            for batch in text_chunks(batches, limit=SLICE):
                _, some, h, bounds = _sets(batch.column("text").to_pylist())
                if not len(some):
                    continue
                at = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
                cols = list(zip(*(batch.column(c).to_pylist() for c in ("vid", "doc_id", "home", "pivot", "m", "blocks")), strict=True))
                named = set_keys(h, bounds).view(np.int64).tolist()
                for k, i in enumerate(some.tolist()):
                    if at[i] != now:
                        yield from link(now, rows, sets)
                        now, rows, sets = at[i], {}, {}
                    vid = cols[i][0]
                    if named[k] == vid:  # of rows that repeat an id, the class's own
                        rows[vid], sets[vid] = cols[i], h[bounds[k] : bounds[k + 1]].copy()
            yield from link(now, rows, sets)

        return _batches(found())

    def compare(placed: DataFrame) -> DataFrame:
        text = placed.join(texts.select("vid", "doc_id", "text").hint("merge"), "vid")
        return text.repartition(partitions(text), *keys).sortWithinPartitions(*keys).mapInArrow(run, _FOUND)

    return _components_of(rows, "root", compare, scratch, "links")


def _components(plain: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """(doc_id, th, n, component, kept) for every row of ``plain`` (doc_id, text, th)."""
    scratch = Scratch(plain.sparkSession)
    table = scratch.keep(signature_table(plain, coordinates), "signatures")
    classes = table.where("vid is not null and doc_id is not null").groupBy("vid")
    classes = scratch.keep(classes.agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")), "classes")
    reps = classes.select("vid", "rep")
    groups = candidate_groups(classes, match_threshold(coordinates, percent), match_threshold(max(SKETCH, coordinates), percent), scratch)
    members = scratch.keep(reps.join(groups.hint("merge"), "vid").select(F.col("rep").alias("doc_id"), "vid", "tree"), "members")
    scratch.drop_all_but(table, classes, members)
    linked = verified_links(plain, members, percent, scratch)
    linked = linked.select(F.col("node").alias("rep"), F.col("root").alias("component"))
    of = reps.join(linked.hint("merge"), "rep", "left").select("vid", F.coalesce("component", "rep").alias("component"))
    out = table.select("doc_id", "th", "n", "vid").join(of.hint("merge"), "vid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    done = out.select("doc_id", "th", "n", component.alias("component"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    done = scratch.keep(done, "components")
    scratch.drop_all_but(done)
    return done


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = column(text_col).cast("string")
    return docs.select(column(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def near_duplicates(
    docs: DataFrame, percent: int = 85, coordinates: int = COORDINATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two texts are linked if ``100 * intersection >= percent * union`` of their
    distinct 5-word shingles (words in A-Z lower case; a text of fewer words
    is one shingle).  ``component_id`` is the smallest id reachable.

    Rows: null, empty and blank texts have no shingles and are components of
    their own; rows without an id take no part in linking and get no
    component, but are kept; rows that repeat an id are one document with the
    links of each of their texts.  Other columns are not read.
    """
    found = _components(_plain(docs, id_col, text_col), percent, coordinates)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def drop_duplicates(
    docs: DataFrame, percent: int = 80, coordinates: int = COORDINATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows that :func:`near_duplicates` does not keep.

    Rows that repeat an id and its text stay or go together.  All columns are
    carried along, whatever their names.
    """
    names, cols = carried(docs)
    plain = _plain(docs, id_col, text_col)
    gone = _components(plain, percent, coordinates).where(~F.col("kept")).select("doc_id", "th").distinct()
    text = column(text_col).cast("string")
    every = docs.select(*cols, column(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"))
    return every.join(gone.hint("merge"), ["doc_id", "th"], "left_anti").select(*restored(names))
