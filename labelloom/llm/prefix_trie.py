"""Prefix trie of conversations from padded turn-id matrices.

1. Each turn becomes a 16-byte id (MD5 of role and text) and its number of bytes; the text goes no further.
   Turns are numbered by ranges of (conversation, turn), so that a conversation of any length is
   numbered by many tasks.
2. Every conversation is rebuilt from the first turns of its base conversation and the rest of its own.
3. A rebuilt conversation is cut into blocks of ``WIDTH`` turns. A block carries a 128-bit hash of all turns
   before it, so blocks of all depths are handled at once. Blocks are range-partitioned by (block number, hash,
   ids) into shards of about ``ROWS_PER_SHARD`` rows.
4. Each shard is a padded matrix of turn ids, sorted by numpy's lexsort. Masks of column changes, OR-accumulated
   from left to right, mark where nodes start; reduceat aggregates every depth. Nodes that touch the first or the
   last row of a shard are partial: they are recombined by their path, and go back to the shards.
5. A node belongs to its smallest member, so each conversation owns the nodes from some depth down to its end.
   A subtree's sums are then sums over its members of what they own from that depth on. The same matrix adds them
   up by reduceat, and partial nodes are recombined once more, by their owner and depth.

Cases: rows without a conv_id belong to no conversation and are left out. Null turns come first; turns of equal
number are ordered by the MD5 of role and text, and repeated rows are turns of their own. Null roles and texts count as
empty. Texts are hashed whole. Other columns are ignored. An empty table gives an empty result (no root, as a
node is named after a member). A node's end ids may be many: their hash is fed piece by piece, as SHA-256 asks for,
so that one task reads all ids of one node, in memory for one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import quoted, release, stored

WIDTH = 16  # turns in a block: columns of the matrix
ROWS_PER_SHARD = 1 << 15
TURNS_PER_PART = 1 << 17
BLOCKS_PER_SPAN = 1 << 10

PARTIAL = "shard int, side int, level int, block long, p1 long, p2 long, path binary, n long, low long, high long"
OWNED = (
    "shard int, nth int, c long, length long, block long, owners array<long>, worth array<long>, "
    "own_first boolean, last_owner long, saved long, leaf long"
)
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
PIECE = NODE.replace("ends_sha256 string", "shard int, whole boolean, ends_sha256 string, ends binary")

ARROW = {
    "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """The schema that a worker returns, read without a session."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def given_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % 5


# --- rebuilt conversations -----------------------------------------------------------


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored turns (part, conv_id, inner, id, size) and the offsets (part, conv_id, n, before) of their numbers."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    light = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)))).alias("id"),
        F.octet_length(text).cast("long").alias("size"),
        # tells repeated rows apart, so that they may lie in several parts
        F.monotonically_increasing_id().alias("row"),
    ).filter("conv_id IS NOT NULL")
    parts = max(1, -(-light.count() // TURNS_PER_PART))
    order = ["turn", "id", "row"]
    dealt = light.repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id())
    inner = F.row_number().over(W.partitionBy("part", "conv_id").orderBy(*order)) - 1
    turns = stored(dealt.select("part", "conv_id", inner.cast("long").alias("inner"), "id", "size"), "trie-turns")
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counted = turns.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    return turns, counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Turns (c, length, at, id, size) of the rebuilt conversations, and (c, length) of all of them."""
    turns, offsets = numbered_turns(conversations)
    offsets = stored(offsets, "trie-offsets")
    lengths = offsets.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = lengths.select("conv_id", "n", given_turns(F.col("conv_id")).alias("h"), base_of(F.col("conv_id")).alias("base"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    is_base = F.col("conv_id") == F.col("base")
    given = F.when(is_base, 0).otherwise(F.least("h", F.coalesce("base_n", F.lit(0))))
    skipped = F.when(is_base, 0).otherwise(F.col("h"))
    plan = (
        convs.join(bases, "base", "left")
        .select("conv_id", "base", "n", given.cast("long").alias("given"), skipped.cast("long").alias("skipped"))
        .withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("skipped"), F.lit(0)))
    )
    plan = stored(plan, "trie-plan")
    placed = turns.join(offsets.join(plan, "conv_id").drop("n"), ["part", "conv_id"]).withColumn(
        "pos", F.col("before") + F.col("inner")
    )
    own = placed.filter("pos >= skipped").select(
        F.col("conv_id").alias("c"), "length", (F.col("pos") - F.col("skipped") + F.col("given")).alias("at"), "id", "size"
    )
    # the first turns of a base meet the few conversations that take them
    first = placed.filter("conv_id = base AND pos < 8").select("base", F.col("pos").alias("at"), "id", "size")
    takers = plan.filter("conv_id <> base AND given > 0").select("base", F.col("conv_id").alias("c"), "length", "given")
    taken = first.join(takers, "base").filter("at < given").select("c", "length", "at", "id", "size")
    return own.unionByName(taken), plan.select(F.col("conv_id").alias("c"), "length"), [turns, offsets, plan]


# --- blocks --------------------------------------------------------------------------


def running(df: DataFrame, fold: dict[str, tuple], later: bool = False) -> DataFrame:
    """Per conversation the fold of columns over the blocks before (or after) each, by spans first.

    ``fold`` maps a new name to (column, aggregate, combination of two values, value of nothing).
    """
    spanned = df.withColumn("_span", F.expr(f"block div {BLOCKS_PER_SPAN}"))
    order = (lambda c: F.col(c).desc()) if later else F.col
    over = {
        "_span": W.partitionBy("c").orderBy(order("_span")).rowsBetween(W.unboundedPreceding, -1),
        "block": W.partitionBy("c", "_span").orderBy(order("block")).rowsBetween(W.unboundedPreceding, -1),
    }
    spans = spanned.groupBy("c", "_span").agg(*[agg(col).alias(f"_t_{k}") for k, (col, agg, _, _) in fold.items()])
    outer = spans.select(
        "c", "_span", *[F.coalesce(agg(f"_t_{k}").over(over["_span"]), F.lit(z)).alias(f"_o_{k}") for k, (_, agg, _, z) in fold.items()]
    )
    inner = spanned.select(
        "*", *[F.coalesce(agg(col).over(over["block"]), F.lit(z)).alias(f"_i_{k}") for k, (col, agg, _, z) in fold.items()]
    )
    joined = inner.join(outer, ["c", "_span"])
    return joined.select(*df.columns, *[put(F.col(f"_o_{k}"), F.col(f"_i_{k}")).alias(k) for k, (_, _, put, _) in fold.items()])


def conversation_blocks(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(c, length, block, p1, p2, path, sizes): the turns of a conversation, ``WIDTH`` at a time."""
    grouped = (
        turns.withColumn("block", F.expr(f"at div {WIDTH}"))
        .groupBy("c", "block")
        .agg(
            F.max("length").alias("length"),
            F.sort_array(F.collect_list(F.struct("at", "id", "size"))).alias("t"),
            F.bit_xor(F.xxhash64("at", "id", F.lit(1))).alias("x1"),
            F.bit_xor(F.xxhash64("at", "id", F.lit(2))).alias("x2"),
        )
        .select(
            "c",
            "length",
            "block",
            "x1",
            "x2",
            F.aggregate("t", F.lit(b""), lambda a, x: F.concat(a, x["id"])).alias("path"),
            F.transform("t", lambda x: x["size"]).alias("sizes"),
        )
    )
    blocks = stored(grouped, "trie-cut")
    xor = lambda a, b: a.bitwiseXOR(b)
    longer = running(
        blocks.filter(f"length > {WIDTH}"), {"p1": (F.col("x1"), F.bit_xor, xor, 0), "p2": (F.col("x2"), F.bit_xor, xor, 0)}
    )
    columns = ["c", "length", "block", "p1", "p2", "path", "sizes"]
    zero = F.lit(0).cast("long")
    short = blocks.filter(f"length <= {WIDTH}").withColumns({"p1": zero, "p2": zero})
    bare = lengths.filter("length = 0").select(
        "c", "length", zero.alias("block"), zero.alias("p1"), zero.alias("p2"), F.lit(b"").alias("path"),
        F.array().cast("array<long>").alias("sizes"),
    )
    out = stored(short.select(columns).unionByName(longer.select(columns)).unionByName(bare), "trie-blocks")
    release(blocks)
    return out


# --- matrices ------------------------------------------------------------------------


class Matrix:
    """The sorted rows of a shard: turn ids padded to ``WIDTH`` columns, and where nodes start.

    Column 0 of ``starts`` stands for what precedes the block, column j for its first j turns.
    """

    def __init__(self, table: pa.Table) -> None:
        col = lambda name: table.column(name).to_numpy()
        paths = table.column("path").combine_chunks()
        raw, sizes = b"".join(paths.to_pylist()), np.array([len(p) for p in paths.to_pylist()], np.int64)
        padded = np.zeros((table.num_rows, WIDTH * 16), np.uint8)
        row = np.repeat(np.arange(table.num_rows), sizes)
        padded[row, np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer(raw, np.uint8)
        ids = padded.view(">u8").astype(np.uint64)
        c, lead = col("c"), (col("block"), col("p1"), col("p2"))
        order = np.lexsort((c, *(ids[:, k] for k in reversed(range(2 * WIDTH))), *reversed(lead)))
        self.order, self.c, self.width, self.length = order, c[order], sizes[order] // 16, col("length")[order]
        self.block, self.p1, self.p2 = (x[order] for x in lead)
        self.padded, ids = padded[order], ids[order]
        changed = np.zeros((len(c), WIDTH + 1), bool)
        changed[0] = True
        for x in (self.block, self.p1, self.p2):
            changed[1:, 0] |= x[1:] != x[:-1]
        pairs = (ids[1:] != ids[:-1]).reshape(len(c) - 1, WIDTH, 2)
        changed[1:, 1:] = pairs.any(axis=2)
        self.starts = np.logical_or.accumulate(changed, axis=1)

    def nodes(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first rows, numbers of rows, which of them are nodes) of the runs of a column."""
        first = np.flatnonzero(self.starts[:, level])
        return first, np.diff(np.append(first, len(self.c))), self.width[first] >= level


def partial_nodes(table: pa.Table) -> pa.Table:
    """The nodes at the borders of a shard: (shard, side, level, path, members, smallest member, longest member)."""
    m = Matrix(table)
    shard, rows = table.column("shard")[0].as_py(), []
    for level in range(WIDTH + 1):
        first, n, node = m.nodes(level)
        for side, k in enumerate((0, len(first) - 1)):
            if node[k] and (side == 0 or k):
                a, b = first[k], first[k] + n[k]
                path = m.padded[a, : 16 * level].tobytes()
                rows.append(
                    (shard, side, level, m.block[a], m.p1[a], m.p2[a], path, n[k], m.c[a:b].min(), m.length[a:b].max())
                )
    schema = arrow_schema(PARTIAL)
    return pa.Table.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)


def owned(table: pa.Table, borders: pa.Table) -> pa.Table:
    """Who owns the nodes along each row, and what they are worth to their owner."""
    schema = arrow_schema(OWNED)
    if not table.num_rows:
        return schema.empty_table()
    m = Matrix(table)
    rows = len(m.c)
    owner, n, high = (np.zeros((rows, WIDTH + 1), np.int64) for _ in range(3))
    whole = {(b["level"], b["side"]): (b["low"], b["n"], b["high"]) for b in borders.to_pylist()}
    for level in range(WIDTH + 1):
        first, size, _ = m.nodes(level)
        found = [np.minimum.reduceat(m.c, first), size.copy(), np.maximum.reduceat(m.length, first)]
        for side, k in ((1, len(first) - 1), (0, 0)):
            if (level, side) in whole:
                for x, value in zip(found, whole[level, side]):
                    x[k] = value
        for x, y in zip((owner, n, high), found):
            x[:, level] = np.repeat(y, size)
    levels = np.arange(WIDTH + 1)
    within = levels[None, :] <= m.width[:, None]
    own = within & (owner == m.c[:, None])
    bytes_of = np.zeros((rows, WIDTH + 1), np.int64)
    sizes = table.column("sizes").combine_chunks().take(pa.array(m.order))
    row = np.repeat(np.arange(rows), m.width)
    bytes_of[row, np.arange(len(row)) - np.repeat(np.cumsum(m.width) - m.width, m.width) + 1] = sizes.flatten().to_numpy()
    worth = np.where(own, (n - 1) * bytes_of, 0)
    last = (np.arange(rows), m.width)
    ended = m.length == m.block * WIDTH + m.width
    leaf = own[last] & ended & (high[last] == m.length)
    lists = lambda x: pa.ListArray.from_arrays(
        pa.array(np.arange(rows + 1) * (WIDTH + 1), pa.int32()), pa.array(x.ravel(), pa.int64())
    )
    columns = [
        np.full(rows, table.column("shard")[0].as_py(), np.int32), np.arange(rows, dtype=np.int32), m.c, m.length, m.block,
        lists(owner), lists(worth), own[:, 1], owner[:, WIDTH], worth.sum(axis=1), leaf.astype(np.int64),
    ]
    return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=schema)


def summed_nodes(table: pa.Table) -> pa.Table:
    """Nodes of a shard by owner and depth; those at its borders are pieces that hold their end ids as text."""
    table = table.sort_by("nth")
    col = lambda name: table.column(name).to_numpy()
    rows = table.num_rows
    matrix = lambda name: table.column(name).combine_chunks().flatten().to_numpy().reshape(rows, WIDTH + 1)
    c, block, length, owner, worth = col("c"), col("block"), col("length"), matrix("owners"), matrix("worth")
    width = np.minimum(length - block * WIDTH, WIDTH)
    ended = length == block * WIDTH + width
    from_here = np.cumsum(worth[:, ::-1], axis=1)[:, ::-1] + col("later_saved")[:, None]
    leaf = col("leaf") + col("later_leaf")
    own = (np.arange(WIDTH + 1)[None, :] <= width[:, None]) & (owner == c[:, None])
    child = np.concatenate([own[:, 1:], col("next_own")[:, None]], axis=1)
    shard, parent_first = int(col("shard")[0]), col("parent_owner")
    out: list[list] = []
    for level in range(WIDTH + 1):
        is_node = (width >= level) & ((level > 0) | (block == 0))
        new = np.ones(rows, bool)
        new[1:] = (owner[1:, level] != owner[:-1, level]) | (block[1:] != block[:-1]) | (is_node[1:] != is_node[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, rows))
        sums = [np.add.reduceat(x.astype(np.int64), first) for x in (child[:, level], leaf, from_here[:, level])]
        ends = np.flatnonzero(ended & (width == level))
        cut = np.searchsorted(ends, np.append(first, rows))
        for k in np.flatnonzero(is_node[first]):
            a = first[k]
            depth = int(block[a]) * WIDTH + level
            parent = None if not depth else owner[a, level - 1] if level > 1 or not block[a] else parent_first[a]
            ids = ",".join(map(str, c[ends[cut[k] : cut[k + 1]]].tolist())).encode()
            whole = bool(k and k < len(first) - 1)
            out.append(
                [owner[a, level], depth, parent, n[k], *(x[k] for x in sums), shard, whole]
                + ([hashlib.sha256(ids).hexdigest(), None] if whole else [None, ids])
            )
    schema = arrow_schema(PIECE)
    return pa.Table.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(schema)], schema=schema)


def joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (conv_id, depth, shard) become nodes: sums, and one running hash of the end ids."""
    schema = arrow_schema(NODE)
    node, digest, started = None, None, False

    def told(nodes: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in nodes], f.type) for j, f in enumerate(schema)], schema=schema)

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            key = (r["conv_id"], r["depth"])
            if node is None or key != tuple(node[:2]):
                if node is not None:
                    done.append([*node, digest.hexdigest()])
                node, digest, started = [*key, r["parent_conv_id"], 0, 0, 0, 0], hashlib.sha256(), False
            for j, name in enumerate(("n_convs", "n_children", "n_leaves", "saved_tokens"), 3):
                node[j] += r[name]
            if r["ends"]:
                digest.update(b"," * started + r["ends"])
                started = True
        if done:
            yield told(done)
    if node is not None:
        yield told([[*node, digest.hexdigest()]])


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    source = conversations.select(*[quoted(x).alias(y) for x, y in ((conv_id, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))])
    turns, lengths, used = rebuilt_turns(source)
    blocks = conversation_blocks(turns, lengths)
    release(*used)
    # shards: ranges of (block, what came before, ids, conversation)
    shards = max(1, -(-blocks.count() // ROWS_PER_SHARD))
    dealt = blocks.repartitionByRange(shards, "block", "p1", "p2", "path", "c").withColumn("shard", F.spark_partition_id())
    rows = stored(dealt, "trie-shards")
    release(blocks)
    node = ["block", "p1", "p2", "path"]
    borders = stored(rows.groupBy("shard").applyInArrow(partial_nodes, PARTIAL), "trie-borders")
    met = borders.groupBy(*node).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    told = borders.select("shard", "side", "level", *node).join(met, node).select("shard", "side", "level", "n", "low", "high")
    marked = stored(rows.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(owned, OWNED), "trie-owned")
    release(rows, borders)

    # what a block of a long conversation knows of its other blocks
    summary = marked.filter(f"length > {WIDTH}").select("c", "block", "own_first", "last_owner", "saved", "leaf")
    add = lambda a, b: a + b
    later = running(
        summary, {"later_saved": (F.col("saved"), F.sum, add, 0), "later_leaf": (F.col("leaf"), F.sum, add, 0)}, later=True
    ).select("c", "block", "later_saved", "later_leaf")
    following = summary.select("c", (F.col("block") - 1).alias("block"), F.col("own_first").alias("next_own"))
    previous = summary.select("c", (F.col("block") + 1).alias("block"), F.col("last_owner").alias("parent_owner"))
    near = later.join(following, ["c", "block"], "left").join(previous, ["c", "block"], "left")
    zero = F.lit(0).cast("long")
    filled = marked.select("shard", "nth", "c", "length", "block", "owners", "worth", "leaf").join(near, ["c", "block"], "left").withColumns(
        {x: F.coalesce(x, zero) for x in ("later_saved", "later_leaf", "parent_owner")} | {"next_own": F.coalesce("next_own", F.lit(False))}
    )
    pieces = stored(filled.groupBy("shard").applyInArrow(summed_nodes, PIECE), "trie-pieces")
    columns = [x.split()[0] for x in NODE.split(", ")]
    split = pieces.filter("NOT whole").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "shard")
    out = stored(pieces.filter("whole").select(columns).unionByName(split.mapInArrow(joined_pieces, NODE)), "trie")
    release(marked, pieces)
    return out
