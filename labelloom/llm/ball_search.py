"""Ranked lexical search: exact inner-product search in sparse ball trees.

1. Documents become sparse vectors of the terms that the items ask for; term counts, lengths and document frequencies
   are taken over all documents, in one scan of the texts.
2. Vectors are range-partitioned by their rarest terms, so that like documents come to the same task. A task
   cuts them into trees of at most ``TREE_DOCS`` documents, split into halves between two far points down to leaves of ``LEAF_DOCS``.
3. A node is a ball: the centroid of its vectors, and one radius for each of ``SUBSPACES`` groups of terms. By Cauchy and
   Schwarz no document below it scores more than q * centroid + sum over groups of |q| * radius; radii and bounds are rounded up by
   more than floating-point sums can lose.
4. For each item the balls are visited best first, until the bound of the next lies below the item's k-th
   best score so far, which a task carries from tree to tree. Leaves are scored in 64-bit integers, so pruning never
   changes a result. Each task returns k documents per item, of which Spark keeps the best.

A query is the set of an item's terms; rows of one item_id are one item, null item_ids included. Items are taken in
blocks of about ``TERMS_PER_BLOCK`` terms, each a pass over the documents, so what a task holds of them is bounded.

Cases: null and empty texts have no terms and are never found. Documents with equal doc_id are ranked each on their own, a null
doc_id after all others of the same score. Texts are read whole. A document's long vector may fill a tree alone. Equal
scores go by ascending doc_id. Without documents or items the result is empty.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import quoted, release, stored

TREE_DOCS = 2048
TREE_ENTRIES = 1 << 20
LEAF_DOCS = 8
SUBSPACES = 2048
TERMS_PER_BLOCK = 1 << 18
DOCS_PER_TASK = 1 << 15
# Terms are runs of ASCII letters, ASCII digits and bytes of other characters; only A-Z are lower-cased.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
NO_ID = (1 << 63) - 1


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text, repeats included."""
    return (text or b"").translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# --- vectors -------------------------------------------------------------------------


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term): the different terms of each item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                own = list(set(terms(t)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(own), pa.int64()), pa.array(own, pa.binary())], ["item_id", "term"]
                )

    source = items.select(quoted(item_id).cast("long").alias("item_id"), quoted(text).alias("text"))
    return source.mapInArrow(split, "item_id long, term binary").distinct()


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): lengths of all documents with a term, and their counts of wanted terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist()):
                    words = terms(t)
                    if words:
                        found = [(wanted[w], c) for w, c in Counter(words).items() if w in wanted]
                        rows.append((i, len(words), [x for x, _ in found], [c for _, c in found]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                        pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return docs.mapInArrow(counted, "doc_id long, n long, terms array<int>, tfs array<long>")


def vectors(counts: DataFrame, place: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(s0, s1, s2, doc_id, cols, xs): integer vectors by frequency rank of their terms, and their rarest three."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, cols, tfs = (c.to_pylist() for c in batch.columns)
            signs, columns, values = [], [], []
            for n, c, t in zip(lengths, cols, tfs):
                rank = place[np.array(c, np.int64)]
                order = np.argsort(rank)
                # Python integers: 90 * n * N may pass 64 bits
                m = 10 + 90 * n * n_docs // n_terms
                tf = np.array(t, np.int64)[order]
                columns.append(rank[order])
                values.append(1_000_000_000 * tf // (1000 * tf + 8 * m))
                signs.append((rank[order][::-1][:3].tolist() + [-1] * 3)[:3])
            offsets = np.append(0, np.cumsum([len(c) for c in columns])).astype(np.int32)
            flat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s[j] for s in signs], pa.int32()) for j in range(3)]
                + [
                    pa.array(ids, pa.int64()),
                    pa.ListArray.from_arrays(offsets, flat(columns, pa.int32())),
                    pa.ListArray.from_arrays(offsets, flat(values, pa.int64())),
                ],
                ["s0", "s1", "s2", "doc_id", "cols", "xs"],
            )

    kept = counts.filter(F.size("terms") > 0)
    return kept.mapInArrow(made, "s0 int, s1 int, s2 int, doc_id long, cols array<int>, xs array<long>")


# --- ball trees ----------------------------------------------------------------------


def group_of(rank: np.ndarray) -> np.ndarray:
    """The subspace of a term: the most frequent terms have one each, the others share the other half."""
    half = SUBSPACES // 2
    return np.where(rank < half, rank, half + rank % half)


class BallTree:
    """Balls over some sparse vectors: halves of halves, in the order of their documents."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, cols: np.ndarray, xs: np.ndarray) -> None:
        self.terms, cols = np.unique(cols, return_inverse=True)
        order = self._halved(sizes, cols, xs.astype(np.float64))
        start = np.cumsum(sizes) - sizes
        flat = np.repeat(start[order] - np.append(0, np.cumsum(sizes[order])[:-1]), sizes[order]) + np.arange(len(cols))
        self.ids, self.sizes, self.cols, self.xs = ids[order], sizes[order], cols[flat], xs[flat]
        self.ptr = np.append(0, np.cumsum(self.sizes))
        self._balls()

    def _halved(self, sizes: np.ndarray, cols: np.ndarray, xs: np.ndarray) -> np.ndarray:
        """An order of the documents in which each half of a node lies nearer to one of two far points of it."""
        ptr = np.append(0, np.cumsum(sizes))
        dense = np.zeros(len(self.terms))

        def dots(docs: np.ndarray, vector: np.ndarray) -> np.ndarray:
            n = sizes[docs]
            at = np.repeat(ptr[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            return np.add.reduceat(xs[at] * vector[cols[at]], np.cumsum(n) - n)

        def put(doc: int, sign: float) -> None:
            dense[cols[ptr[doc] : ptr[doc + 1]]] += sign * xs[ptr[doc] : ptr[doc + 1]]

        square = np.add.reduceat(xs * xs, ptr[:-1])
        self.bounds: list[tuple[int, int]] = []  # (first, end) of each node, children of k: 2k + 1, 2k + 2
        order = np.arange(len(sizes))
        level = [(0, len(sizes))]
        while True:
            self.bounds += level
            if max(b - a for a, b in level) <= LEAF_DOCS:
                return order
            following = []
            for a, b in level:
                docs = order[a:b]
                if b - a > 1:
                    put(docs[0], 1.0)
                    far = docs[np.argmax(square[docs] - 2 * dots(docs, dense))]
                    put(docs[0], -1.0)
                    put(far, 1.0)
                    other = docs[np.argmax(square[docs] - 2 * dots(docs, dense))]
                    put(other, -1.0)
                    order[a:b] = docs[np.argsort(dots(docs, dense), kind="stable")]
                    dense[:] = 0.0
                middle = (a + b + 1) // 2
                following += [(a, middle), (middle, b)]
            level = following

    def _balls(self) -> None:
        """Centroids as (node, term, value), by term; radii as a matrix of nodes and subspaces."""
        group = group_of(self.terms)
        xs = self.xs.astype(np.float64)
        docs, nodes, n_terms = len(self.ids), len(self.bounds), len(self.terms)
        doc = np.repeat(np.arange(docs), self.sizes)
        squares = np.bincount(doc * SUBSPACES + group[self.cols], xs * xs, docs * SUBSPACES).reshape(docs, SUBSPACES)
        self.radius = np.zeros((nodes, SUBSPACES), np.float32)
        parts, at = [], 0
        while at < nodes:
            level = self.bounds[at : 2 * at + 1]
            first, size = np.array([a for a, _ in level]), np.array([b - a for a, b in level])
            node = np.repeat(np.arange(len(level)), size)
            key, where = np.unique(node[doc] * n_terms + self.cols, return_inverse=True)
            mean = np.bincount(where, xs) / size[key // n_terms]
            parts.append((at + key // n_terms, key % n_terms, mean))
            lost = np.bincount((key // n_terms) * SUBSPACES + group[key % n_terms], mean * mean, len(level) * SUBSPACES)
            lost = lost.reshape(len(level), SUBSPACES)
            cross = np.bincount(doc * SUBSPACES + group[self.cols], xs * mean[where], docs * SUBSPACES).reshape(docs, SUBSPACES)
            some = size > 0
            apart, largest = np.zeros((2, len(level), SUBSPACES))
            apart[some] = np.maximum.reduceat(squares - 2 * cross, first[some], axis=0)
            largest[some] = np.maximum.reduceat(squares, first[some], axis=0)
            # squared distance = apart + lost, rounded up by more than its sums can lose
            squared = np.maximum(apart + lost, 0) + 1e-11 * (largest + lost)
            self.radius[at : at + len(level)] = np.nextafter(np.sqrt(squared).astype(np.float32), np.float32(np.inf))
            at = 2 * at + 1
        node, col, mean = (np.concatenate([p[k] for p in parts]) for k in range(3))
        by_term = np.argsort(col, kind="stable")
        self.centre_node, self.centre = node[by_term], mean[by_term]
        self.centre_ptr = np.searchsorted(col[by_term], np.arange(n_terms + 1))
        self.used = np.array([b > a for a, b in self.bounds])
        self.first_leaf = nodes // 2

    def upper_bounds(self, cols: np.ndarray, ranks: np.ndarray, weights: np.ndarray, norms: tuple) -> np.ndarray:
        """For each node a number that no document below it exceeds. ``cols`` are the places of known query terms."""
        at = np.concatenate([np.arange(self.centre_ptr[c], self.centre_ptr[c + 1]) for c in cols])
        n = self.centre_ptr[cols + 1] - self.centre_ptr[cols]
        near = np.bincount(self.centre_node[at], np.repeat(weights, n) * self.centre[at], len(self.bounds))
        groups, norm = norms
        bound = near + self.radius[:, groups].astype(np.float64) @ norm
        return np.where(self.used, bound * (1 + 1e-9) + 1, -1.0)

    def search(self, query: Query, k: int, dense: np.ndarray) -> int:
        """Put this tree's documents into the query's k best; returns how many leaves were scored."""
        at = np.searchsorted(self.terms, query.ranks)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == query.ranks[known]
        cols, weights = at[known], query.weights[known]
        if not len(cols):
            return 0
        bounds = self.upper_bounds(cols, query.ranks[known], weights, query.norms)
        dense[cols] = weights
        leaves, waiting = 0, [(-bounds[0], 0)]
        while waiting:
            bound, node = heapq.heappop(waiting)
            if -bound < query.least(k):
                break
            if node < self.first_leaf:
                for child in (2 * node + 1, 2 * node + 2):
                    heapq.heappush(waiting, (-bounds[child], child))
                continue
            leaves += 1
            a, b = self.bounds[node]
            if a == b:
                continue
            lo, hi = self.ptr[a], self.ptr[b]
            scores = np.add.reduceat(dense[self.cols[lo:hi]] * self.xs[lo:hi], self.ptr[a:b] - lo)
            for j in np.flatnonzero(scores >= max(1, query.least(k))):
                query.offer(int(scores[j]), int(self.ids[a + j]), k)
        dense[cols] = 0
        return leaves


@dataclass
class Query:
    """An item: its terms by rank, their weights, and the best documents so far."""

    item: int
    ranks: np.ndarray
    weights: np.ndarray
    best: list = field(default_factory=list)

    def __post_init__(self) -> None:
        groups, where = np.unique(group_of(self.ranks), return_inverse=True)
        norm = np.sqrt(np.bincount(where, self.weights.astype(np.float64) ** 2))
        self.norms = groups, norm * (1 + 1e-9)

    def least(self, k: int) -> int:
        """The score that a document needs at least; an equal one may still win by its doc_id."""
        return self.best[0][0] if len(self.best) == k else 1

    def offer(self, score: int, doc_id: int, k: int) -> None:
        entry = (score, -doc_id)
        if len(self.best) < k:
            heapq.heappush(self.best, entry)
        elif entry > self.best[0]:
            heapq.heapreplace(self.best, entry)


def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[BallTree]:
    """Trees over the documents of a task as they come, a bounded number of entries at a time."""
    waiting, docs, entries = [], 0, 0

    def planted() -> BallTree:
        ids, sizes, cols, xs = (np.concatenate(x) for x in zip(*waiting))
        return BallTree(ids, sizes, cols, xs)

    for batch in batches:
        ids = batch.column(0).fill_null(NO_ID).to_numpy()
        cols, xs = batch.column(1), batch.column(2)
        sizes = np.diff(cols.offsets.to_numpy()).astype(np.int64)
        flat_cols, flat_xs = cols.flatten().to_numpy(), xs.flatten().to_numpy()
        ptr, at = np.append(0, np.cumsum(sizes)), 0
        while at < len(ids):
            room = max(1, int(np.searchsorted(ptr, ptr[at] + TREE_ENTRIES - entries, "right")) - 1 - at)
            end = min(len(ids), at + min(room, TREE_DOCS - docs))
            waiting.append((ids[at:end], sizes[at:end], flat_cols[ptr[at] : ptr[end]], flat_xs[ptr[at] : ptr[end]]))
            docs, entries, at = docs + end - at, entries + int(ptr[end] - ptr[at]), end
            if docs >= TREE_DOCS or entries >= TREE_ENTRIES:
                yield planted()
                waiting, docs, entries = [], 0, 0
    if waiting:
        yield planted()


def searched(rows: DataFrame, queries: list[tuple], k: int) -> DataFrame:
    """(item, doc_id, score, n_leaves, n_scored): the k best documents of each task for each item."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [Query(*q) for q in shared.value]
        leaves, scored = 0, [0] * len(wanted)
        for tree in trees(batches):
            leaves += len(tree.bounds) - tree.first_leaf
            dense = np.zeros(len(tree.terms), np.int64)
            for j, query in enumerate(wanted):
                scored[j] += tree.search(query, k, dense)
        out = [(q.item, -d, s, leaves, scored[j]) for j, q in enumerate(wanted) for s, d in q.best]
        names = ["item", "doc_id", "score", "n_leaves", "n_scored"]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(5)], names)

    return rows.select("doc_id", "cols", "xs").mapInArrow(run, "item long, doc_id long, score long, n_leaves long, n_scored long")


@dataclass
class Wanted:
    """A term that an item asks for."""

    item: int
    term: bytes


def search_block(docs: DataFrame, wanted: list[Wanted], k: int) -> DataFrame | None:
    """The best documents of each task for some items, given as rows of item number and term; None if no term occurs."""
    vocabulary = {t: j for j, t in enumerate(sorted({bytes(r.term) for r in wanted}))}
    counts = stored(term_counts(docs, vocabulary), "search-counts")
    sums = counts.agg(F.count("*").alias("docs"), F.sum("n").alias("terms"), F.count_if(F.size("terms") > 0).alias("known")).first()
    if not sums.known:
        release(counts)
        return None
    # a number for each term of the block
    df = np.zeros(len(vocabulary), np.int64)
    frequency = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df[frequency.column("term").to_numpy()] = frequency.column("df").to_numpy()
    place = np.empty(len(df), np.int32)
    place[np.argsort(-df, kind="stable")] = np.arange(len(df))
    asked: dict[int, list[tuple[int, int]]] = {}
    for r in wanted:
        j = vocabulary[bytes(r.term)]
        if df[j] and (w := weight(sums.docs, int(df[j]))):
            asked.setdefault(r.item, []).append((int(place[j]), w))
    queries = [(i, np.array([p for p, _ in sorted(x)]), np.array([w for _, w in sorted(x)], np.int64)) for i, x in asked.items()]
    tasks = max(1, -(-sums.known // DOCS_PER_TASK))
    signed = stored(vectors(counts, place, sums.docs, sums.terms), "search-vectors")
    order = ["s0", "s1", "s2", "doc_id"]
    found = searched(signed.repartitionByRange(tasks, *order).sortWithinPartitions(*order), queries, k)
    best = stored(found, "search-best")
    release(counts, signed)
    return best


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item; and how many leaves its search scored."""
    spark = docs.sparkSession
    source = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    # blocks by a hash of item_id; null is an item like others
    asked = stored(item_terms(items, item_id, item_text), "search-items")
    n_blocks = max(1, -(-asked.count() // TERMS_PER_BLOCK))
    block = F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("null"))), F.lit(n_blocks))
    found = []
    for b in range(n_blocks):
        rows = asked.filter(block == b).collect()
        ids = sorted({r.item_id for r in rows}, key=lambda x: (x is None, x or 0))
        number = {x: j for j, x in enumerate(ids)}
        best = search_block(source, [Wanted(number[r.item_id], bytes(r.term)) for r in rows], k) if rows else None
        if best is not None:
            names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int64()), "item_id": pa.array(ids, pa.int64())}))
            found.append(best.join(names, "item").drop("item"))
    release(asked)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, n_leaves long, n_scored long")
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", real.alias("doc_id"), "score", "n_leaves", "n_scored")

