"""Keyword rules of any number: an inverted index on the rarest gram of each rule.

A rule holds for a text that contains all its keywords, so the text also contains every
*gram* of them: a stretch of ``GRAM`` bytes, or a whole keyword that is shorter. Each rule is
filed under its *anchor*, the rarest in all texts of ``CONSIDERED`` of its grams. A text then asks for its
own grams only, of which few are anchors, and only the rules filed there are tested.

The grams of a text leave it as (item, gram) rows, and only if a bitmap of fixed size says
that they may be anchors; the text itself moves once, to the candidates that need a test,
whatever the number of rules. An anchor that very many texts contain (a rule like "the", or one
without any keyword, whose anchor is the empty gram of every text) is dealt over ``SALTS``
copies of its rules. Tables with copies for salts are joined by an explicit merge join: the planner
takes them for the files they come from, so it would build sixteen times as much as that in the driver.

More than ``JOINED`` rules are sent to the texts in blocks instead, as their (text, rule) pairs outgrow both tables:
see ``rule_blocks``.

Texts and keywords are lower-cased, cut and finally compared by the same built-in functions as
in the plan of a few rules, so the meaning is the same. Only the grams are cut in Arrow batches:
built-in functions that list all stretches of a text took thirty times as long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import contains_all
from labelloom.operators import rule_blocks
from labelloom.session import release, stored
from labelloom.sizing import compute_once

# Bytes of a gram, at most 7. Longer ones are rarer, but only keywords of that length have any.
GRAM = 7
# Grams of a rule among which the rarest is looked for: those with the lowest hashes.
CONSIDERED = 16
SALTS = 16
# Bits of the map of wanted grams: 8 MB, sent to every task.
MAP_BITS = 26
PART_BITS = 16
# Bytes of text that are cut at a time, and counted grams that a task holds.
SLICE = 1 << 20
KEPT = 1 << 20
# Rules that are joined with the grams of the texts, at most.
JOINED = 512


# --- grams ---------------------------------------------------------------------------


def byte_grams(raw: np.ndarray, size: int) -> np.ndarray:
    """The stretches of ``size`` bytes as numbers: the size in the highest byte, the bytes below."""
    n = len(raw) - size + 1
    out = np.zeros(max(n, 0), np.int64)
    for k in range(size):
        out = (out << 8) | raw[k : k + n]
    return out | (size << 56)


def numbered(gram: bytes) -> int:
    """A gram as the number that ``byte_grams`` gives it."""
    return len(gram) << 56 | int.from_bytes(gram, "big")


def keyword_grams(keyword: bytes) -> list[int]:
    size = min(len(keyword), GRAM)
    return [numbered(keyword[k : k + size]) for k in range(len(keyword) - size + 1)]


def places(gram: np.ndarray) -> np.ndarray:
    """The bit of each gram in the map."""
    x = gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def rule_grams(rules: DataFrame) -> DataFrame:
    """(ord, gram): some of the grams of all keywords of ``rules(ord, kws)``, at most ``CONSIDERED``, at least one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords, found = [], []
            for order, kws in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.array(sorted({g for k in kws for g in keyword_grams(k.encode())}), np.int64)
                own = own[np.argsort(places(own), kind="stable")[:CONSIDERED]]
                ords += [order] * len(own)
                found += own.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ords, pa.int64()), pa.array(found, pa.int64())], ["ord", "gram"])

    return rules.select("ord", "kws").mapInArrow(cut, "ord long, gram long")


def gram_map(wanted: DataFrame) -> tuple[list[int], np.ndarray]:
    """The sizes of the grams of ``wanted(gram)``, and the map with a bit set for each.

    Tasks set the bits of a part each; 2**MAP_BITS bits come here however many grams there are.
    """

    def built(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        bits = np.zeros(1 << PART_BITS, bool)
        bits[table.column("bit").to_numpy() & ((1 << PART_BITS) - 1)] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"part": pa.array([part], pa.int64()), "bits": pa.array([packed], pa.binary())})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = places(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bit >> PART_BITS), pa.array(bit)], ["part", "bit"])

    bits = wanted.select("gram").mapInArrow(placed, "part long, bit long").distinct()
    parts = bits.groupBy("part").applyInArrow(built, "part long, bits binary").toArrow()
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    width = 1 << (PART_BITS - 3)
    for part, raw in zip(parts.column("part").to_pylist(), parts.column("bits").to_pylist()):
        out[part * width : (part + 1) * width] = np.frombuffer(raw, np.uint8)
    sizes = wanted.select(F.shiftright("gram", 56).alias("size")).distinct().collect()
    return sorted(r.size for r in sizes), out


def slices(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """(number, piece) of texts, some at a time. Pieces of a long text overlap, so that no gram is lost."""
    waiting, held = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text), 1), SLICE):
            waiting.append((k, text[at : at + SLICE + GRAM - 1]))
            held += len(waiting[-1][1])
            if held >= SLICE:
                yield waiting
                waiting, held = [], 0
    if waiting:
        yield waiting


def slice_grams(part: list[tuple[int, bytes]], sizes: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of texts, grams) that may be wanted, each as often as it occurs."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    raw = np.frombuffer(b"".join(p for _, p in part), np.uint8)
    row = np.repeat(np.array([k for k, _ in part], np.int64), [len(p) for _, p in part])
    for size in sizes:
        if size and len(raw) >= size:
            gram = byte_grams(raw, size)
            place = places(gram)
            hit = np.flatnonzero(((bits[place >> 3] >> (place & 7)) & 1).astype(bool) & (row[: len(gram)] == row[size - 1 :]))
            rows.append(row[hit])
            found.append(gram[hit])
    if 0 in sizes:
        own = np.array([k for k, _ in part], np.int64)
        rows.append(own)
        found.append(np.zeros(len(own), np.int64))
    return np.concatenate(rows), np.concatenate(found)


def once_each(row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def batch_grams(texts: list[bytes], sizes: list[int], bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of texts, grams) that may be wanted, each once per text, some texts at a time."""
    open_row, kept = -1, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for part in slices(texts):
        row, gram = (np.concatenate(x) for x in zip(kept, slice_grams(part, sizes, bits)))
        row, gram = once_each(row, gram)
        # the last text may go on in the next slice
        open_row = part[-1][0]
        done = row != open_row
        yield row[done], gram[done]
        kept = row[~done], gram[~done]
    yield kept


def text_grams(lowered: DataFrame, wanted: DataFrame) -> DataFrame:
    """(item_id, gram): the grams of ``lowered(item_id, t)`` that may be among ``wanted(gram)``.

    One row per row of ``lowered`` and gram, so an item that occurs twice has its grams twice.
    """
    shared = lowered.sparkSession.sparkContext.broadcast(gram_map(wanted))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, gram in batch_grams(batch.column(1).cast(pa.large_binary()).to_pylist(), *shared.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(gram)], ["item_id", "gram"])

    kind = lowered.schema["item_id"].dataType.simpleString()
    return lowered.filter("t IS NOT NULL").select("item_id", "t").mapInArrow(cut, f"item_id {kind}, gram long")


def gram_frequency(lowered: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, n): how often each gram occurs in all texts, added up in a task before the shuffle."""
    shared = lowered.sparkSession.sparkContext.broadcast(gram_map(wanted))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> tuple[np.ndarray, np.ndarray]:
            gram, where = np.unique(np.concatenate([g for g, _ in sums]), return_inverse=True)
            return gram, np.bincount(where, np.concatenate([n for _, n in sums]), len(gram)).astype(np.int64)

        for batch in batches:
            for part in slices(batch.column(0).cast(pa.large_binary()).to_pylist()):
                sums.append(np.unique(slice_grams(part, *shared.value)[1], return_counts=True))
                if sum(len(g) for g, _ in sums) > KEPT:
                    sums = [joined()]
                    if len(sums[0][0]) > KEPT // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums[0]], ["gram", "n"])
                        sums = []
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined()], ["gram", "n"])

    found = lowered.filter("t IS NOT NULL").select("t").mapInArrow(counted, "gram long, n long")
    return found.groupBy("gram").agg(F.sum("n").alias("n"))


# --- index ---------------------------------------------------------------------------


def salts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))


def anchored(lowered: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with ``anchor``: of its grams the one that occurs least.

    The count covers all texts. Grams that no text contains come first: such a rule never
    becomes a candidate.
    """
    filed = stored(rule_grams(rules), "rule-grams")
    frequency = stored(gram_frequency(lowered, filed.select("gram").distinct()), "gram-frequency")
    # the larger number has the longer gram
    rarest = F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), -F.col("gram")))
    # a gram may be part of very many rules: its count is one row, copied for their salts
    salted = filed.withColumn("salt", F.pmod(F.xxhash64("ord"), F.lit(SALTS)))
    found = salted.join(frequency.withColumn("salt", salts()).hint("merge"), ["gram", "salt"], "left")
    out = stored(rules.hint("merge").join(found.groupBy("ord").agg(rarest.alias("anchor")), "ord"), "rule-index")
    release(filed, frequency)
    return out


def rules_that_hold(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(item_id, columns of the rule): one row per text of ``items(item_id, text)`` and rule that holds for it.

    ``rules`` has a unique long ``ord``, ``kws`` (lower-cased keywords, not null) and any other
    columns. A rule without keywords holds for every text that is not null; an empty keyword
    always does. Up to ``JOINED`` rules, the result is a stored table, see ``session.release``.
    """
    payload = [c for c in rules.columns if c != "kws"]
    lowered = compute_once(items, "item_id", t=F.lower("text"))
    # an empty keyword says nothing; a rule of such keywords only is filed under the empty gram
    said = F.filter(F.array_distinct("kws"), lambda k: k != "")
    cleaned = stored(rules.withColumn("kws", F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("")))), "rules")
    if cleaned.count() > JOINED:
        out = rule_blocks.rules_that_hold(lowered, cleaned)
        release(cleaned)
        return out
    index = anchored(lowered, cleaned)
    hits = text_grams(lowered, index.select(F.col("anchor").alias("gram")).distinct())
    filed = index.select(F.col("anchor").alias("gram"), F.struct(*payload, "kws").alias("rule")).withColumn("salt", salts())
    salt = F.pmod(F.xxhash64("item_id"), F.lit(SALTS))
    met = hits.withColumn("salt", salt).join(filed.hint("merge"), ["gram", "salt"])
    # an item has each rule once, so its group is bounded by the rules filed under its grams
    asked = met.groupBy(F.col("item_id").alias("_id")).agg(F.collect_set("rule").alias("asked"))
    tested = lowered.filter("t IS NOT NULL").join(asked, F.col("item_id").eqNullSafe(F.col("_id")))
    passed = F.filter("asked", lambda r: contains_all(F.col("t"), r["kws"]))
    proven = tested.select("item_id", F.explode(passed).alias("rule")).select("item_id", *[f"rule.{c}" for c in payload])
    out = stored(proven, "rules-held")
    release(cleaned, index)
    return out
