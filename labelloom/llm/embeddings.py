"""Embedding near-dedup by sorted projection passes.

1. Rows with equal vectors form a class; one vector of a class goes on.
2. In each pass a vector's key is the concatenated signs of random projections. Vectors are sorted by
   (pass, leading signs), and all that agree in the leading signs are compared, in blocks where they are
   many. A pair at the threshold agrees in a sign with a probability that depends on nothing else, so the
   number of passes follows from the number of signs and the wanted recall, however dense the table is.
   Density decides the cost only: how many vectors agree in 0, 1, 2, ... signs is counted over all
   vectors, and the cheapest number of signs is taken. With none, all pairs are compared.
3. What a pass finds is sent on as a spanning forest. The forests of all passes together give
   components, and within each component all pairs are compared in double precision, in blocks. So the
   passes limit only how a group is found, never how many links its members have.

Cases: vectors that are null, zero, empty, or hold null or non-finite components have no links.
Vectors of different lengths aren't compared. Rows with equal vectors are linked with each other.
Rows that repeat a vec_id count each; labels and other columns play no part. The smallest vec_id is
taken over non-null ids. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import quoted, release, stored
from labelloom.llm.groups import blocked, components, spanning, whole_groups

WINDOW = 128
BLOCK = 2048
KEY_BITS = 64
# Passes over all vectors that the density is counted in.
COUNTED_PASSES = 4
# To send a vector costs as much as to compare it with so many windows.
SEND_WINDOWS = 16


def passes_needed(vectors: int, threshold: float, recall: float, window: int = WINDOW) -> int:
    """Two vectors at the threshold agree in a sign with probability 1 - angle / pi; they are compared when
    they agree in as many leading signs as cut evenly spread vectors down to a window."""
    agree = 1 - math.acos(threshold) / math.pi
    meet = agree ** math.log2(max(vectors / window, 1.0))
    return 1 if meet >= recall else math.ceil(math.log1p(-recall) / math.log1p(-meet))


def usable(vector) -> np.ndarray | None:
    """The vector in double precision, or none if it can't be compared."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def projections(number: int, dims: int) -> np.ndarray:
    return np.random.default_rng([number, dims, 11]).standard_normal((KEY_BITS, dims)).astype(np.float32)


def named(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, vector): the class of each row and its vector as bytes; both null if it isn't comparable."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if v is None else v.tobytes() for v in map(usable, batch.column(1).to_pylist())]
            nodes = [None if r is None else xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(raw, pa.binary())],
                ["vec_id", "node", "vector"],
            )

    return vectors.mapInArrow(made, "vec_id long, node long, vector binary")


def pass_keys(classes: DataFrame, passes: int, signs: int) -> DataFrame:
    """(pass, bucket, node, half): one row per pass, with the leading signs and the unit vector in half precision."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = np.uint64(1) << np.arange(signs, dtype=np.uint64)[::-1]
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            units = [unit(np.frombuffer(r)) for r in batch.column(1).to_pylist()]
            for dims in sorted({len(u) for u in units}):
                own = [k for k, u in enumerate(units) if len(u) == dims]
                x = np.stack([units[k] for k in own]).astype(np.float32)
                half = pa.array([h.tobytes() for h in x.astype(np.float16)], pa.binary())
                for p in range(passes):
                    if (p, dims) not in planes:
                        planes[p, dims] = projections(p, dims)[:signs]
                    bucket = ((x @ planes[p, dims].T > 0) * weights).sum(axis=1, dtype=np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), p, np.int32)), pa.array(bucket.view(np.int64)), pa.array(nodes[own]), half],
                        ["pass", "bucket", "node", "half"],
                    )

    return classes.mapInArrow(keyed, "pass int, bucket long, node long, half binary")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (pass, key): per batch and number of signs, the runs of equal leading signs at both ends of
    the batch with their lengths, and the sum of squares of the lengths between."""
    for batch in batches:
        out = []
        p, key = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        for signs in range(KEY_BITS + 1) if len(key) else ():
            lead = key >> np.uint64(KEY_BITS - signs) if signs else np.zeros_like(key)
            at = np.flatnonzero(np.append(True, (lead[1:] != lead[:-1]) | (p[1:] != p[:-1])))
            n = np.diff(np.append(at, len(key)))
            for k in {0, len(at) - 1}:
                out.append((signs, int(p[at[k]]), int(lead[at[k] : at[k] + 1].view(np.int64)[0]), int(n[k]), 0))
            out.append((signs, None, None, 0, int((n[1:-1] ** 2).sum())))
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ("signs", "pass", "lead", "n", "squares")
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)


def meetings(classes: DataFrame) -> dict[int, float]:
    """For each number of leading signs: comparisons in a pass if all vectors that agree in them are compared."""
    keys = pass_keys(classes, COUNTED_PASSES, KEY_BITS).select("pass", F.col("bucket").alias("key"))
    ordered = keys.repartitionByRange("pass", "key").sortWithinPartitions("pass", "key")
    whole = (
        ordered.mapInArrow(runs, "signs int, pass int, lead long, n long, squares long")
        .groupBy("signs", "pass", "lead")
        .agg(F.sum(F.col("n").cast("double")).alias("n"), F.sum(F.col("squares").cast("double")).alias("squares"))
    )
    # one number for each number of signs
    rows = whole.groupBy("signs").agg(F.sum(F.col("n") * F.col("n") + F.col("squares")).alias("pairs")).collect()
    return {r.signs: r.pairs / COUNTED_PASSES for r in rows}


def cheapest(classes: DataFrame, n: int, threshold: float, recall: float, window: int) -> tuple[int, int, float]:
    """(signs, passes, comparisons) of least cost among those that give the wanted recall."""
    if n <= BLOCK:
        return 0, 1, float(n * n)
    sent = SEND_WINDOWS * window
    agree = 1 - math.acos(threshold) / math.pi
    best = None
    for signs, pairs in sorted(meetings(classes).items()):
        if agree**signs < 1e-6:
            break
        passes = passes_needed(window << signs, threshold, recall, window)
        # a vector is sent once, and once more for every further block of its bucket
        cost = passes * (pairs + sent * (n + pairs / BLOCK))
        if best is None or cost < best[0]:
            best = cost, signs, passes, passes * pairs
    return best[1:]


def bucket_edges(keys: DataFrame, comparisons: float, threshold: float) -> DataFrame:
    """Spanning edges (a, b) of the pairs that buckets hold; half precision errs by less than 0.002."""
    limit = threshold - 0.002
    order = ["pass", "bucket", "one", "two"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, order):
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            nodes, halves = table.column("node").to_numpy(), table.column("half").to_pylist()
            for s, e in zip(bounds[:-1], bounds[1:]):
                for size in {len(r) for r in halves[s:e]}:
                    same = [i for i in range(s, e) if len(halves[i]) == size]
                    x = np.frombuffer(b"".join(halves[i] for i in same), np.float16).reshape(len(same), -1).astype(np.float32)
                    linked = x @ x.T >= limit
                    np.fill_diagonal(linked, False)
                    near = np.flatnonzero(linked.any(axis=1))
                    if len(near):
                        edges = np.array(spanning(linked[np.ix_(near, near)]), np.int64)
                        ids = nodes[same][near]
                        left.append(ids[edges[:, 0]])
                        right.append(ids[edges[:, 1]])
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    sizes = keys.groupBy("pass", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = blocked(keys, sizes, ["pass", "bucket"], "node", BLOCK).select(*order, "node", "half")
    # tasks by comparisons, not by bytes
    most = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, int(comparisons) >> 24))
    ordered = dealt.repartition(parts, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(compared, "a long, b long").distinct()


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, null, links) and (a, b, null), as the exact comparison of all pairs of each component gives them."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    dealt = blocked(members, sizes, "component", "node", BLOCK)
    order = ["component", "one", "two"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, order):
            out_a, out_b, out_n = [], [], []
            for s, e in zip(bounds[:-1], bounds[1:]):
                part = table.slice(s, e - s)
                nodes, copies, own = (part.column(c).to_numpy() for c in ("node", "copies", "own"))
                x = np.stack([unit(np.frombuffer(r)) for r in part.column("vector").to_pylist()])
                linked = x @ x.T >= threshold
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

    parts = dealt.repartition(*order).sortWithinPartitions(*order).select(*order, "node", "copies", "own", "vector")
    return stored(parts.mapInArrow(compared, "a long, b long, n long"), "vector-links")


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    recall: float = 0.999,
    window: int = WINDOW,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = stored(named(vectors.select(quoted(vec_id), quoted(embedding))), "vectors")
    classes = stored(
        rows.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")),
        "vector-classes",
    )
    n = classes.count()
    vectors = classes.select("node", "vector")
    signs, passes, comparisons = cheapest(vectors, n, threshold, recall, window)
    edges = stored(bucket_edges(pass_keys(vectors, passes, signs), comparisons, threshold), "vector-edges")
    near = components(edges, "near-vectors")
    members = stored(near.join(classes, "node").select("component", "node", "copies", "vector"), "vector-members")
    found = verified(members, threshold)
    groups = components(found.filter("b IS NOT NULL").select("a", "b"), "vector-groups")
    links = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    told = (
        classes.select("node", "rep", "copies")
        .join(groups, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(links, "node", "left")
    )
    least = told.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = told.join(least, "component").select(
        "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"
    )
    own = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = stored(
        rows.select("vec_id", "node")
        .join(stored(linked, "vector-told"), "node", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            own.alias("component_id"),
            F.col("vec_id").eqNullSafe(own).alias("kept"),
        ),
        "vector-out",
    )
    release(rows, classes, edges, near, members, found, groups)
    return out
