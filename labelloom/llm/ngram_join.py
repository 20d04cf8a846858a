"""Near-duplicate join on word n-grams: MinHash banding finds candidates, full n-gram sets decide.

1. Each text becomes the set of hashes of its five-word windows. Texts with equal sets form a class;
   only one document of a class goes on.
2. MinHash: the numbers of bands and of rows in a band are chosen for the wanted recall at the
   threshold. Band hashes are shuffled with a small sketch (two bits of every min-hash). Within a
   band's group, sketches that agree far too little for the threshold are set aside, and a spanning
   forest of the rest is all that is sent on: never the pairs of a group.
3. Connected candidates are brought together, and all their pairs are verified on the full sets, in
   blocks of bounded size. Tasks return link counts and again spanning forests.
4. Components of the verified links are the groups of near copies.

Losses: a pair at the threshold shares no band with probability 1 - recall (below 1e-4), or fails the
sketch test (about 1e-7); either hides a link only if no chain of other similar texts connects the two.

Cases: texts without words (null, empty, blank) have no links and are all kept. Texts of fewer than
five words have one gram, the whole text. Texts with equal sets have similarity 1. Rows that repeat a
doc_id are documents of their own; of a group one row stays, of the smallest doc_id (nulls last).
Texts are read whole. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from labelloom.llm.bloom_lm import WordHashes, mix
from labelloom.llm.common import quoted, release, stored
from labelloom.llm.groups import blocked, components, spanning, whole_groups

HASHES = 150
BAND_BLOCK = 2048
SET_BLOCK = 512


def choose_bands(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have while pairs at the threshold meet with the wanted recall."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    raise ValueError("no band layout reaches this recall")


def gram_set(text: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word windows; one for a shorter text; none without words."""
    words = (text or b"").split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.array([hashes[x] for x in words], np.uint64)
    width = min(n, len(w))
    out = w[: len(w) - width + 1]
    for k in range(1, width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - width + 1 + k])
    return np.unique(out)


def set_node(grams: np.ndarray) -> int | None:
    """A signed 64-bit name of a set; none for the empty one."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None


def seeds() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return x[:HASHES] | np.uint64(1), x[HASHES:]


def min_hashes(grams: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), 1024):
        np.minimum(out, ((grams[k : k + 1024, None] ^ masks) * factors).min(axis=0), out=out)
    return out


def sketch_of(mins: np.ndarray) -> bytes:
    """Two bits of each min-hash."""
    two = (mix(mins) & np.uint64(3)).astype(np.uint8)
    return np.packbits(np.stack([two >> 1, two & 1], axis=1).ravel()).tobytes()


SKETCH_WORDS = -(-2 * HASHES // 64)
PAIRS_MASK = np.uint64(0x5555555555555555)


def sketches(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(8 * SKETCH_WORDS, b"\0") for x in raw), np.uint64).reshape(-1, SKETCH_WORDS)


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many min-hashes two sketches see differ (a quarter of the differing ones go unseen)."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & PAIRS_MASK).sum(axis=-1)


def most_unequal(threshold: float) -> int:
    """Five standard deviations beyond what a pair at the threshold shows."""
    p = (1 - threshold) * 0.75
    return math.ceil(HASHES * p + 5 * math.sqrt(HASHES * p * (1 - p)))


PREPARED = "doc_id long, node long, bands array<long>, sketch binary"


def prepared(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Set name, band hashes and sketch of each document; ``docs`` is (doc_id, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (factors, masks) = WordHashes(), seeds()
        for batch in batches:
            ids, nodes, keys, marks = batch.column(0), [], [], []
            for t in batch.column(1).cast(pa.large_binary()).to_pylist():
                grams = gram_set(t, n, hashes)
                nodes.append(set_node(grams))
                if not len(grams):
                    keys.append(None)
                    marks.append(None)
                    continue
                mins = min_hashes(grams, factors, masks)
                key = np.full(bands, 7, np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + mins[r : bands * rows : rows])
                keys.append(key.view(np.int64))
                marks.append(sketch_of(mins))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["doc_id", "node", "bands", "sketch"],
            )

    return docs.mapInArrow(made, PREPARED)


def candidate_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """Spanning edges (a, b) of sketches that may be similar, within each band's groups."""
    limit = most_unequal(threshold)
    rows = stored(
        classes.select(F.posexplode("bands").alias("band", "hash"), "node", "sketch").select(
            F.xxhash64("band", "hash").alias("key"), "node", "sketch"
        ),
        "bands",
    )
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = blocked(rows, sizes, "key", "node", BAND_BLOCK)
    order = ["key", "one", "two"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, order):
            nodes, marks = table.column("node").to_numpy(), sketches(table.column("sketch").to_pylist())
            size, start = np.diff(bounds), bounds[:-1]
            two = start[size == 2]
            near = two[unequal(marks[two], marks[two + 1]) <= limit]
            left, right = [nodes[near]], [nodes[near + 1]]
            for s, k in zip(start[size > 2], size[size > 2]):
                own = marks[s : s + k]
                linked = np.stack([unequal(own, x) <= limit for x in own])
                edges = np.array(spanning(linked), np.int64).reshape(-1, 2)
                left.append(nodes[s + edges[:, 0]])
                right.append(nodes[s + edges[:, 1]])
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    parts = dealt.repartition(*order).sortWithinPartitions(*order).select(*order, "node", "sketch")
    edges = stored(parts.mapInArrow(joined, "a long, b long").distinct(), "candidates")
    release(rows)
    return edges


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many grams each pair of sets shares."""
    if len(sets) <= 4:
        out = np.zeros((len(sets), len(sets)), np.int64)
        for i in range(len(sets)):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    number = np.cumsum(new) - 1
    often = np.bincount(number) > 1
    use = often[number]
    column, owner = (np.cumsum(often) - 1)[number[use]], owner[use]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for k in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [k, k + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - k] = 1
        out += part @ part.T
    return out.astype(np.int64)


FOUND = "a long, b long, n long"


def verified(docs: DataFrame, members: DataFrame, n: int, threshold: float) -> DataFrame:
    """Rows (node, null, links) with link counts, and (a, b, null) with spanning edges of verified links."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    # the members grow with the corpus: always by a shuffle
    texts = docs.join(members.hint("merge"), docs.doc_id.eqNullSafe(members.rep)).select("component", "node", "copies", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(3).cast(pa.large_binary()).to_pylist()
            found = [gram_set(t, n, hashes) for t in texts]
            # another document of the same doc_id isn't the one that was asked for
            right = [set_node(g) == node for g, node in zip(found, batch.column(1).to_pylist())]
            grams = pa.array([g.tobytes() for g in found], pa.binary())
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], grams], ["component", "node", "copies", "grams"])
            yield out.filter(pa.array(right, pa.bool_()))

    with_sets = texts.mapInArrow(sets, "component long, node long, copies long, grams binary")
    dealt = blocked(with_sets, sizes, "component", "node", SET_BLOCK)
    order = ["component", "one", "two"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, order):
            out_a, out_b, out_n = [], [], []
            for s, e in zip(bounds[:-1], bounds[1:]):
                part = table.slice(s, e - s)
                nodes, first = np.unique(part.column("node").to_numpy(), return_index=True)
                copies, own = part.column("copies").to_numpy()[first], part.column("own").to_numpy()[first]
                raw = part.column("grams").to_pylist()
                found = [np.frombuffer(raw[i], np.uint64) for i in first]
                size = np.array([len(g) for g in found])
                shared = shared_counts(found)
                linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
                np.fill_diagonal(linked, False)
                if part.column("one")[0].as_py() != part.column("two")[0].as_py():
                    linked &= own[:, None] != own[None, :]
                links = linked @ copies
                out_a += nodes[links > 0].tolist()
                out_b += [None] * int((links > 0).sum())
                out_n += links[links > 0].tolist()
                for i, j in spanning(linked):
                    out_a.append(int(nodes[i]))
                    out_b.append(int(nodes[j]))
                    out_n.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_n, pa.int64())], ["a", "b", "n"]
            )

    parts = dealt.repartition(*order).sortWithinPartitions(*order).select(*order, "node", "copies", "own", "grams")
    return stored(parts.mapInArrow(compared, FOUND), "verified")


def near_duplicates(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, node (of its n-gram set), class_id, n_links, component_id, kept.

    ``class_id`` is the smallest doc_id with the same n-gram set, ``n_links`` the number of other rows
    at the threshold or above, ``component_id`` the smallest doc_id reachable by links.
    """
    bands, rows = choose_bands(threshold, recall)
    source = docs.select(quoted(doc_id).cast(LongType()).alias("doc_id"), quoted(text).alias("text"))
    marks = stored(prepared(source, n, bands, rows).withColumn("row", F.monotonically_increasing_id()), "ngram-marks")
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")).alias("least")
    classes = stored(
        marks.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(lowest, F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .select("node", "least", F.col("least.doc_id").alias("rep"), "copies", "bands", "sketch"),
        "ngram-classes",
    )
    edges = candidate_edges(classes, threshold)
    near = components(edges, "near")
    members = stored(near.join(classes, "node").select("component", "node", "rep", "copies"), "members")
    found = verified(source, members, n, threshold)
    groups = components(found.filter("b IS NOT NULL").select("a", "b"), "links")
    links = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = (
        classes.select("node", "least", "rep", "copies")
        .join(groups, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(links, "node", "left")
    )
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    told = stored(
        named.join(least, "component").select(
            "node",
            F.col("rep").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.col("first.doc_id").alias("component_id"),
            F.col("first.row").alias("first_row"),
        ),
        "ngram-told",
    )
    out = stored(
        marks.select("doc_id", "node", "row")
        .join(told, "node", "left")
        .select(
            "doc_id",
            "node",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)).alias("kept"),
        ),
        "ngram-out",
    )
    release(marks, classes, edges, near, members, found, groups, told)
    return out


def drop_near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies."""
    found = near_duplicates(docs, n, threshold, doc_id=doc_id, text=text)
    names = docs.columns
    schema = StructType([*docs.schema.fields]).add("_llm_node", LongType())
    at = names.index(text)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            nodes = [set_node(gram_set(t, n, hashes)) for t in batch.column(at).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], [*names, "_llm_node"])

    marked = docs.mapInArrow(named, schema)
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("_llm_id"), F.col("node").alias("_llm_other")).distinct()
    stays = found.filter("kept").select(F.col("doc_id").alias("_llm_id"), F.col("node").alias("_llm_other"))
    same = quoted(doc_id).eqNullSafe(F.col("_llm_id")) & (F.col("_llm_node") == F.col("_llm_other"))
    # a row whose id and grams stay somewhere stays; rows that repeat both are told apart by the count that goes
    alone = marked.join(gone.join(stays, ["_llm_id", "_llm_other"], "left_anti").hint("merge"), same, "left_anti")
    repeated = gone.join(stays, ["_llm_id", "_llm_other"], "left_semi")
    if repeated.isEmpty():
        return alone.select(*[quoted(c) for c in names])
    twice = alone.join(repeated, same, "left_semi").dropDuplicates([doc_id, "_llm_node"])
    once = alone.join(repeated, same, "left_anti")
    return once.unionByName(twice).select(*[quoted(c) for c in names])
