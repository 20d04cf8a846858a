"""Line dedup: lines that many documents share are found through sharded minimal perfect hashes.

1. Each task counts in how many of its documents each line key occurs; the counts are summed by key.
2. The distinct keys are dealt into shards of bounded size. Each shard gets a minimal perfect hash:
   levels of bit arrays in which a key owns the bit that no other key of its level wants. The rank
   of that bit indexes an array of 32-bit fingerprints and an array of counts.
3. Documents send only their keys (12 bytes each) to the shards and probe the arrays there. A shard
   that a very common line makes hot is copied, and its probes are dealt over the copies.
4. The keys to drop come back by doc_id, and each text is rewritten whole.

All distinct keys are in the index, so a probe never meets an unknown key: the fingerprint only
tells apart keys that agree in the first 64 bits of their hash.

Cases: a null or empty text is one empty line and never loses it. An empty line has no key (keys
have ``min_key`` code points or more). A line repeated within one document counts once. Rows that
share a doc_id, null included, are separate documents, each rewritten by its own lines. Lines are
whole, however long. Other columns pass through; ``n_lines``, ``n_dropped`` and ``kept_sha256`` replace
columns of the same names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from labelloom.llm.common import SPACES, quoted, stored

KEYS_PER_SHARD = 1 << 17
PROBES_PER_TASK = 1 << 20
STRIP = SPACES.encode()
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends and A-Z lower-cased (bytes.lower touches ASCII only)."""
    return line.strip(STRIP).lower()


def long_enough(key: bytes, min_key: int) -> bool:
    return len(key) >= min_key and (len(key) >= 4 * min_key or len(key.decode()) >= min_key)


def digest(key: bytes) -> bytes:
    """12 bytes: 8 that place the key, 4 that prove it."""
    return xxhash.xxh3_128_digest(key)[:12]


def doc_digests(text: bytes | None, min_key: int) -> set[bytes]:
    keys = {line_key(x) for x in (text or b"").split(b"\n")}
    return {digest(k) for k in keys if long_enough(k, min_key)}


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def mixed(h: np.ndarray, level: int) -> np.ndarray:
    x = (h ^ np.uint64(level * 0x51ED2701 + 1)) * GOLDEN
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def perfect_hash(h: np.ndarray, slack: float = 1.5) -> list[np.ndarray]:
    """Bit arrays of the levels for distinct 64-bit hashes; every key ends with a bit of its own."""
    levels, left = [], h
    while len(left):
        size = max(64, int(len(left) * slack))
        place = mixed(left, len(levels)) % np.uint64(size)
        wanted = np.bincount(place.astype(np.int64), minlength=size)
        levels.append(wanted == 1)
        left = left[wanted[place.astype(np.int64)] != 1]
    return levels


def look_up(h: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The number of each hash, from 0; -1 for one that no level holds (an unknown key may also get any number)."""
    found = np.full(len(h), -1, np.int64)
    left, base = np.arange(len(h)), 0
    for k, bits in enumerate(levels):
        if not len(left):
            break
        place = (mixed(h[left], k) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[place]
        rank = np.cumsum(bits)
        found[left[hit]] = base + rank[place[hit]] - 1
        base += int(rank[-1])
        left = left[~hit]
    return found


def split_digests(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 12)
    return raw[:, :8].copy().view("<u8").ravel(), raw[:, 8:].copy().view("<u4").ravel()


def build_shard(h: np.ndarray, f: np.ndarray, n: np.ndarray) -> dict:
    """Levels, fingerprints and counts of one shard; keys that share all 64 bits go to a short list."""
    _, first = np.unique(h, return_index=True)
    single = np.zeros(len(h), bool)
    single[first] = True
    levels = perfect_hash(h[single])
    at = look_up(h[single], levels)
    prints, counts = np.zeros(len(at), "<u4"), np.zeros(len(at), "<i8")
    prints[at], counts[at] = f[single], n[single]
    return {
        "sizes": [len(x) for x in levels],
        "bits": b"".join(np.packbits(x).tobytes() for x in levels),
        "prints": prints.tobytes(),
        "counts": counts.tobytes(),
        "spare_h": h[~single].tobytes(),
        "spare_f": f[~single].astype("<u4").tobytes(),
        "spare_n": n[~single].astype("<i8").tobytes(),
    }


def probe_shard(h: np.ndarray, f: np.ndarray, shard: dict) -> np.ndarray:
    """The count of each key, 0 for one the shard does not hold."""
    levels, at = [], 0
    for size in shard["sizes"]:
        width = (size + 7) // 8
        levels.append(np.unpackbits(np.frombuffer(shard["bits"], np.uint8, width, at))[:size].astype(bool))
        at += width
    prints, counts = np.frombuffer(shard["prints"], "<u4"), np.frombuffer(shard["counts"], "<i8")
    found = look_up(h, levels)
    safe = np.maximum(found, 0)
    out = np.where((found >= 0) & (prints[safe] == f), counts[safe], 0) if len(prints) else np.zeros(len(h), np.int64)
    spare = zip(
        np.frombuffer(shard["spare_h"], "<u8"), np.frombuffer(shard["spare_f"], "<u4"), np.frombuffer(shard["spare_n"], "<i8")
    )
    for sh, sf, sn in spare:
        out = np.where((h == sh) & (f == sf), sn, out)
    return out


INDEX = (
    "shard long, copies long, sizes array<int>, bits binary, prints binary, counts binary, "
    "spare_h binary, spare_f binary, spare_n binary"
)


def line_counts(docs: DataFrame, text: str, min_key: int) -> DataFrame:
    """(digest, n): in how many documents each line key occurs, summed per batch before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for t in texts_of(batch):
                seen.update(doc_digests(t, min_key))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["digest", "n"]
            )

    rows = docs.select(quoted(text).alias("text")).mapInArrow(counted, "digest binary, n long")
    return rows.groupBy("digest").agg(F.sum("n").alias("n"))


def shard_of(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards))


def line_index(counts: DataFrame) -> DataFrame:
    """One row per shard of about ``KEYS_PER_SHARD`` distinct keys. ``counts`` must be stored."""
    schema = to_arrow_schema(StructType.fromDDL(INDEX))
    shards = max(1, -(-counts.count() // KEYS_PER_SHARD))

    def built(table: pa.Table) -> pa.Table:
        h, f = split_digests(table.column("digest").to_pylist())
        n = table.column("n").to_numpy()
        # a document sends each of its keys once, so the counts say how many probes come
        row = {"shard": table.column("shard")[0].as_py(), "copies": -(-int(n.sum()) // PROBES_PER_TASK)}
        return pa.Table.from_pylist([row | build_shard(h, f, n)], schema)

    return counts.withColumn("shard", shard_of(shards)).groupBy("shard").applyInArrow(built, INDEX)


def shared_digests(docs: DataFrame, doc_id: str, text: str, index: DataFrame, min_docs: int, min_key: int) -> DataFrame:
    """(id, digests): per doc_id the keys that occur in ``min_docs`` documents or more, joined to one value."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch)):
                own = doc_digests(t, min_key)
                ids += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.binary())], ["id", "digest"])

    def probed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(["id", "digest"]).slice(0, 0)
        h, f = split_digests(left.column("digest").to_pylist())
        hit = probe_shard(h, f, right.slice(0, 1).to_pylist()[0]) >= min_docs
        return left.select(["id", "digest"]).filter(pa.array(hit))

    shards = max(1, index.count())
    copies = index.filter("copies > 1").select("shard", "copies")
    probes = (
        docs.select(quoted(doc_id).cast("string").alias("id"), quoted(text).alias("text"))
        .mapInArrow(sent, "id string, digest binary")
        .withColumn("shard", shard_of(shards))
        .join(copies, "shard", "left")
        .withColumn("copy", F.pmod(F.xxhash64("id", "digest"), F.coalesce("copies", F.lit(1))))
        .select("id", "digest", "shard", "copy")
    )
    dealt = index.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    hits = (
        probes.groupBy("shard", "copy").cogroup(dealt.groupBy("shard", "copy")).applyInArrow(probed, "id string, digest binary")
    )
    return hits.groupBy("id").agg(F.array_join(F.collect_set(F.hex("digest")), "").alias("digests"))


def drop_shared_lines(
    docs: DataFrame, min_docs: int = 10, min_key: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with rewritten texts, and n_lines, n_dropped, kept_sha256 of each."""
    counts = stored(line_counts(docs, text, min_key), "line-counts")
    index = stored(line_index(counts), "line-index")
    # all shards exist: pmod deals some keys to each, unless there are no keys at all
    drops = stored(shared_digests(docs, doc_id, text, index, min_docs, min_key), "line-drops")
    new = {"n_lines": "long", "n_dropped": "long", "kept_sha256": "string"}
    passed = [f for f in docs.schema.fields if f.name.lower() not in new]
    names = [f.name for f in passed]
    joined = (
        docs.select(*[quoted(n) for n in names], quoted(doc_id).cast("string").alias("_llm_id"))
        # the drop list grows with the corpus: always by a shuffle, at any size
        .join(drops.hint("merge"), F.col("_llm_id").eqNullSafe(F.col("id")), "left")
        .select(*[quoted(n) for n in names], F.col("digests").alias("_llm_digests"))
    )
    schema = StructType(passed)
    for n, t in new.items():
        schema = schema.add(n, t)
    at = names.index(text)

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, lost, hashes = [], [], [], []
            for t, d in zip(texts_of(batch, text), batch.column(len(names)).to_pylist()):
                lines = (t or b"").split(b"\n")
                kept = lines
                if d:
                    raw = bytes.fromhex(d)
                    gone = {raw[k : k + 12] for k in range(0, len(raw), 12)}
                    kept = [x for x in lines if digest(line_key(x)) not in gone]
                out = b"\n".join(kept)
                texts.append(None if t is None else out.decode())
                total.append(len(lines))
                lost.append(len(lines) - len(kept))
                hashes.append(hashlib.sha256(out).hexdigest())
            columns = [*batch.columns[: len(names)]]
            columns[at] = pa.array(texts, pa.string())
            columns += [pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *new])

    return joined.mapInArrow(rewritten, schema)
