"""Connected components, and exact verification of all pairs within components, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import release, stored


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric boolean matrix connects; fewer than its rows."""
    n = len(linked)
    left, out = np.ones(n, bool), []
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        frontier = [start]
        while frontier:
            x = frontier.pop()
            new = np.flatnonzero(linked[x] & left)
            left[new] = False
            out += [(x, int(y)) for y in new]
            frontier += new.tolist()
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, bounds): rows sorted by ``keys``, in tables that end where a group ends."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([*kept, batch]).combine_chunks()
            new = np.zeros(table.num_rows, bool)
            for k in keys:
                c = table.column(k).to_numpy()
                new[1:] |= c[1:] != c[:-1]
            cuts = np.flatnonzero(new)
            if len(cuts):
                last = int(cuts[-1])
                yield table.slice(0, last), np.concatenate([[0], cuts])
                table = table.slice(last)
            kept = table.to_batches()
    if kept:
        table = pa.Table.from_batches(kept)
        yield table, np.array([0, table.num_rows])


def components(edges: DataFrame, stem: str) -> DataFrame:
    """(node, component): for each node of ``edges(a, b)`` the smallest node it is connected with.

    Every round points each node at its smallest neighbour (by a hash, so that long chains
    shrink too), follows the pointers to the roots, and contracts the edges to roots. At most
    half of the nodes with edges remain, so rounds grow with the logarithm. Keys with very many
    edges meet only in sums and in joins that Spark can split.
    """
    both = stored(edges.filter("a <> b").select("a", "b").distinct(), stem)
    found = stored(both.select(F.col("a").alias("node")).union(both.select("b")).distinct().withColumn("root", F.col("node")), stem)
    while not both.isEmpty():
        mirrored = both.select("a", "b").union(both.select("b", "a"))
        order = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("b"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        least = mirrored.groupBy("a").agg(F.min(order).alias("m"))
        points = stored(least.select(F.col("a").alias("node"), F.when(F.col("m") < own, F.col("m.b")).otherwise(F.col("a")).alias("to")), stem)
        while True:  # pointer jumping: distances to the roots halve
            ahead = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = stored(points.join(ahead, "to").select("node", F.col("to").alias("was"), F.col("next").alias("to")), stem)
            done = jumped.filter("was <> to").isEmpty()
            release(points)
            points = jumped.drop("was")
            points._stored_at = jumped._stored_at
            if done:
                break
        hop = points.select(F.col("node").alias("root"), "to")
        newer = stored(found.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root")), stem)
        to_a = points.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        to_b = points.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        shorter = both.join(to_a, "a").join(to_b, "b").filter("ra <> rb")
        ordered = shorter.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        left = stored(ordered, stem)
        release(both, found, points)
        both, found = left, newer
    smallest = found.groupBy("root").agg(F.min("node").alias("component"))
    out = stored(found.join(smallest, "root").select("node", "component"), stem)
    release(both, found)
    return out


def blocked(members: DataFrame, sizes: DataFrame, key: str | list[str], item: str, block: int) -> DataFrame:
    """Each member of each group, once for every pair of blocks it takes part in.

    Groups of up to ``block`` members stay whole (block pair 0, 0). Larger ones are cut by a hash
    into blocks of about that size; every pair of blocks becomes a task of its own, so no task
    ever holds more than two blocks. ``sizes`` has (key, n) for groups of two or more. Adds ``own``
    (the member's block), ``one`` and ``two`` (the pair).
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    placed = members.join(sizes.withColumn("_blocks", blocks).drop("n"), key).withColumn(
        "own", F.pmod(F.xxhash64(item, F.lit(7)), F.col("_blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return (
        placed.withColumn("_other", other)
        .withColumn("one", F.least("own", "_other"))
        .withColumn("two", F.greatest("own", "_other"))
        .drop("_blocks", "_other")
    )
