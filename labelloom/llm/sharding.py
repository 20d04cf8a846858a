"""Sharding by balanced label propagation: equal texts move together, and shard sizes stay even.

Documents start in the shard of a hash of their id. Documents with equal texts are linked. As linked
documents in one shard are interchangeable, the state is how many documents of each group are in each
shard; an iteration joins it with the shards' loads:

1. every group prefers the shard that holds most of it, of those that can take more;
2. its documents elsewhere ask to move there; requests are summed by destination and by a coarse
   rank (large shares first), and a destination grants ranks as long as its quota allows;
3. groups too large for one shard fill one and go on with the next.

Groups of more than a 64th of a shard are few (at most 64 for each shard) and are granted one by one. A
shard's linked documents never exceed its quota. At the end the linked documents take their places and all
others fill the shards up: each stays where it started while there is room there, the rest go where
room is left. Law ``rows``: the numbers of documents of two shards differ by one at most.

Cut edges are links between shards; a group within one shard has none. Groups can only be cut by the
quotas. Nothing is grouped by text or shard in one task: ranks within shards and groups are counted by
hash ranges.

Cases: a null text has size 8, crc 0 and no links; empty texts are equal texts. A null doc_id is hashed
as such. Rows that repeat a doc_id are documents of their own, equal texts among them linked. Fewer
documents than shards leave shards empty. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import quoted, ranked, release, stored

ROUNDS = 6
CELLS = 256


def base_rows(docs: DataFrame, shards: int, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, size, text_crc32, group, start, h): h spreads the rows evenly over the longs."""
    raw = quoted(text).cast("binary")
    return docs.select(
        quoted(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(quoted(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.sha2(raw, 256).alias("digest"),
        F.xxhash64(quoted(doc_id), raw).alias("h"),
    ).select(
        F.monotonically_increasing_id().alias("row"),
        "*",
        F.substring("digest", 1, 32).alias("group"),
        F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("start"),
    ).drop("digest")


def looked_up(values: dict[int, int], shard: Column) -> Column:
    """The value of each shard, from a literal map of at most ``shards`` entries."""
    entries = [F.lit(x) for k, v in values.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*entries), shard).cast("long")


def capped(state: DataFrame, quota: dict[int, int]) -> DataFrame:
    """``state(group, shard, n)`` with no more linked documents in a shard than its quota; the excess has shard -1.

    A shard's documents are summed by hash range and dropped from the range on in which the quota ends.
    """
    cell = F.pmod(F.xxhash64("group"), F.lit(CELLS * 64)).alias("cell")
    run = W.partitionBy("shard").orderBy("cell")
    upto = (
        state.groupBy("shard", cell)
        .agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(run))
        .filter(F.col("upto") > looked_up(quota, F.col("shard")))
        .groupBy("shard")
        .agg(F.min("cell").alias("stop"))
    )
    placed = state.join(upto, "shard", "left")
    outside = F.coalesce(cell >= F.col("stop"), F.lit(False))
    return placed.select("group", F.when(outside, F.lit(-1)).otherwise(F.col("shard")).alias("shard"), "n")


def propagate(state: DataFrame, quota: dict[int, int], round_no: int) -> DataFrame:
    """One iteration: new (group, shard, n), with shard -1 for documents that have no place yet."""
    # one number for each shard: bounded by the parameter ``shards``
    load = {r.shard: r.load for r in state.groupBy("shard").agg(F.sum("n").alias("load")).collect()}
    room = {k: q - load.get(k, 0) for k, q in quota.items()}
    free = [k for k in room if room[k] > 0]
    # a group's best shard has room for the rest of it, or at least for a fair part of a quota, or holds all of it
    of_group = W.partitionBy("group")
    seen = state.withColumn("whole", F.sum("n").over(of_group))
    rest = F.col("whole") - F.col("n")
    fair = F.least(rest, F.greatest(F.lit(1), F.floor(looked_up(quota, F.col("shard")) / 16)))
    able = (F.col("shard") >= 0) & ((looked_up(room, F.col("shard")) >= fair) | (rest == 0))
    pull = F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard")
    best = F.max(F.when(able, pull)).over(of_group)
    # of a group none of whose shards has room, documents without a place ask at one that has; a small group moves whole
    other = F.get(F.array(*map(F.lit, free)).cast("array<int>"), F.pmod(F.xxhash64("group", F.lit(round_no)), F.lit(max(len(free), 1))).cast("int"))
    # nobody leaves a shard for one that holds less of the group
    stuck = best.isNull() & (rest > 0) & (16 * F.col("whole") <= looked_up(quota, F.lit(0)))
    goal = F.when((F.col("shard") < 0) | stuck, F.coalesce(best["shard"], other)).when(F.col("n") <= best["n"], best["shard"])
    moves = stored(seen.withColumn("goal", goal), "shard-wishes")
    asked = (
        moves.filter("goal IS NOT NULL AND shard <> goal")
        .withColumn("room", looked_up(room, F.col("goal")))
        .withColumn("quota", looked_up(quota, F.col("goal")))
    )
    # large requests one by one, in order of size: at most 64 for each quota of documents
    large = F.col("n") * 64 >= F.col("quota")
    line = W.partitionBy("goal").orderBy(F.desc("n"), "group", "shard").rowsBetween(W.unboundedPreceding, -1)
    big = asked.filter(large).withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))).withColumn(
        "granted", F.greatest(F.lit(0), F.least("n", F.col("room") - F.col("before")))
    )
    used = big.groupBy("goal").agg(F.sum("granted").alias("used"))
    # small ones by rank: moves of large groups first, then by hash
    rank = (63 - F.floor(F.log2(F.col("whole").cast("double")))).cast("int") * CELLS + F.pmod(F.xxhash64("group"), F.lit(CELLS))
    small = asked.filter(~large).withColumn("rank", rank)
    run = W.partitionBy("goal").orderBy("rank")
    stop = (
        small.groupBy("goal", "room", "rank").agg(F.sum("n").alias("n"))
        .join(used, "goal", "left")
        .withColumn("upto", F.sum("n").over(run) + F.coalesce("used", F.lit(0)))
        .filter("upto > room").groupBy("goal").agg(F.min("rank").alias("stop"))
    )
    granted_small = small.join(stop, "goal", "left").filter("stop IS NULL OR rank < stop").withColumn("granted", F.col("n"))
    granted = big.select("group", "shard", "goal", "granted").unionByName(
        granted_small.select("group", "shard", "goal", "granted")
    ).filter("granted > 0")
    changes = granted.select("group", "shard", (-F.col("granted")).alias("n")).unionByName(
        granted.select("group", F.col("goal").alias("shard"), F.col("granted").alias("n"))
    )
    kept = moves.select("group", "shard", "n").unionByName(changes)
    out = stored(kept.groupBy("group", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "shard-state")
    release(moves)
    return out


def cut_links(state: DataFrame) -> int:
    """Documents that aren't in the shard that holds most of their group."""
    most = state.groupBy("group").agg((F.sum("n") - F.max("n")).alias("cut"))
    return most.agg(F.sum("cut")).first()[0] or 0


def by_ranges(counts: DataFrame, keys: list[str], order: list[str], n: str) -> DataFrame:
    """Add ``first``: where each row's range begins when ``n`` places are given to each row in turn within ``keys``."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum(n).over(before), F.lit(0)))


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = stored(base_rows(docs, shards, doc_id, text), "shard-rows")
    n_rows = rows.count()
    quota = {k: n_rows // shards + (k < n_rows % shards) for k in range(shards)}
    groups = rows.filter("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("members")).filter("members > 1")
    groups = stored(groups, "shard-groups")
    # copies of a large group meet in sums only; its name comes to them by a join that Spark may split
    linked = stored(rows.join(groups.select("group"), "group").select("row", "doc_id", "h", "group", "start"), "shard-linked")
    state = linked.groupBy("group", F.col("start").alias("shard")).agg(F.count("*").alias("n"))
    state = capped(state, quota)
    state = stored(state.groupBy("group", "shard").agg(F.sum("n").alias("n")), "shard-state")
    for k in range(rounds):
        older, state = state, propagate(state, quota, k)
        release(older)
    # linked documents take the places of their group in turn
    spans = by_ranges(state, ["group"], ["shard"], "n").filter("shard >= 0")
    numbered = ranked(linked, ["group"], "h", n_rows, "place")
    spread = spans.groupBy("group").agg(F.collect_list(F.struct("first", "n", "shard")).alias("spans"))  # at most one a shard
    found = F.get(F.filter("spans", lambda s: (F.col("place") >= s["first"]) & (F.col("place") < s["first"] + s["n"])), 0)
    placed = stored(
        numbered.join(spread, "group", "left").select("row", found["shard"].alias("shard")), "shard-placed"
    )
    # all others stay where they started, or fill what is free
    load = {r.shard: r["count"] for r in placed.filter("shard IS NOT NULL").groupBy("shard").count().collect()}
    room = {k: q - load.get(k, 0) for k, q in quota.items()}
    known = placed.select("row", F.col("shard").alias("home"), F.lit(True).alias("is_linked"))
    joined = stored(rows.join(known, "row", "left"), "shard-joined")
    lone = stored(joined.filter("is_linked IS NULL").select("row", "doc_id", "h", F.col("start").alias("shard")), "shard-lone")
    stays = ranked(lone, ["shard"], "h", n_rows, "place").withColumn("fits", F.col("place") < looked_up(room, F.col("shard")))
    stays = stored(stays.select("row", "doc_id", "h", "shard", "fits"), "shard-stays")
    homeless = stays.filter("NOT fits").select("row", "doc_id", "h").unionByName(
        joined.filter("is_linked AND home IS NULL").select("row", "doc_id", "h")
    )
    homeless = stored(homeless.withColumn("one", F.lit(1)), "shard-homeless")
    came = {r.shard: r["count"] for r in stays.filter("fits").groupBy("shard").count().collect()}
    ends, total = [], 0
    for k in range(shards):
        total += room[k] - came.get(k, 0)
        ends.append(total)
    # the first shard whose gaps end behind the place
    past = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end <= F.col("place"))) if shards else F.lit(0)
    moved = ranked(homeless, ["one"], "h", n_rows, "place").select("row", past.cast("int").alias("to"))
    final = (
        joined.join(stays.filter("fits").select("row", F.col("shard").alias("stay")), "row", "left")
        .join(moved, "row", "left")
        .select("doc_id", "size", "text_crc32", "h", F.coalesce("home", "stay", "to").alias("shard"))
    )
    final = stored(final, "shard-final")
    out = ranked(final, ["shard"], "h", n_rows, "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    release(rows, groups, linked, state, placed, joined, lone, stays, homeless)
    return out
