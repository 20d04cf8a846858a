"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

1. Tasks hash words and bigrams of the training texts and count them per chunk. Spark groups the chunks'
   counts by ranges of the hash, one row a chunk and range, and each range is summed by itself.
2. A count c has the level floor(log2 c). The filter holds a gram once per level from 0 on, so a
   count is read by asking for level 0, 1, 2, ... until the answer is no.
   The filter is cut into parts of 128 KB by the first bits of the hash; each part is set by one task.
   It is broadcast if the grams of so much text fit ``max_parts`` parts, whichever they are. Otherwise grams
   move once, a quarter of the ranges after another: the task that sums a range also keeps where each chunk's grams stand in its list, sets and
   reads its parts of the filter, and sends one level per gram back, in the order in which the chunk sent them.
   Texts are then kept as numbers of their chunk's different words, so that they are cut once.
3. A token's probability mixes the bigram estimate with a unigram estimate, both read from the filter:
   (1 - bigram_weight) * (c(w) + 0.5) / (N + 0.5 (V + 1)) + bigram_weight * c(v, w) / c(v).

Beside it stands the exact add-one unigram score. Of a filter that is broadcast, the most frequent words
(``head_words`` at most) are broadcast with their counts; the tokens of all other words are joined with
theirs. Otherwise the ranges send the words' counts back beside their levels. All ways are exact.

Cases: a null or empty text is its end token alone. A null doc_id belongs to the training rows. Every
row is scored on its own, repeated ones too. Without any training row N and V are 0 and base scores are
log10(1 / 1) = 0 a token. Texts are whole, however long. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import batch_bytes, quoted, release, stored

PART_BYTES = 1 << 17
LINES = PART_BYTES // 64
BITS_PER_ENTRY = 12
PROBES = 4
COUNT_TOKENS = 400_000
# Tokens of a chunk that is kept as numbers of its words.
CHUNK_TOKENS = 400_000
# Grams of such chunks move in so many turns, each of other ranges, as they take more disk than the chunks.
TURNS = 4
SCORE_TOKENS = 100_000
CACHE_WORDS = 150_000
# Text whose grams of one kind one range of hashes holds, and counts that are cut into parts at a time.
RANGE_BYTES = 1 << 22
PART_ROWS = 400_000
# Texts that a task is handed at a time, and whose words are cut at a time.
BATCH_BYTES = 1 << 22
SLICE_BYTES = 1 << 20
SLICE_ROWS = 256
# Hashes of two tokens that no text contains: the end, and what stands before the first word.
END = xxhash.xxh64_intdigest(b" end")
START = xxhash.xxh64_intdigest(b" start")


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    @staticmethod
    def of(words: np.ndarray) -> np.ndarray:
        """Hashes of different words: to look them up takes longer than to hash them again."""
        return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(3) + mix(w))


def token_hashes(texts: pa.Array, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of tokens, their hashes): texts A-Z lower-cased, cut at ASCII white space, an end token each."""
    # copied first: pyarrow 23 lower-cases the wrong bytes of a slice that was cast
    own = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    lowered = pc.ascii_lower(pc.fill_null(own, ""))
    pieces = pc.ascii_split_whitespace(lowered)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    words = pieces.flatten()
    # white space at the ends of a text cuts off an empty piece
    said = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    coded = words.dictionary_encode()
    different = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    h = hashes.of(different)
    lengths = np.bincount(text[said], minlength=len(texts)) + 1
    out = np.full(lengths.sum(), END, np.uint64)
    out[np.arange(said.sum()) + text[said]] = h[coded.indices.to_numpy(zero_copy_only=False)[said]]
    return lengths, out


def is_held_out(doc_id, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def before(tokens: np.ndarray) -> np.ndarray:
    """The token before each: also the start of a document, which is what follows an end token."""
    out = np.empty_like(tokens)
    out[0] = START
    out[1:] = tokens[:-1]
    out[out == np.uint64(END)] = START
    return out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of at most SLICE_BYTES of text in all, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends, k = np.cumsum(size, dtype=np.int64), 0
        while k < batch.num_rows:
            end = int(np.searchsorted(ends, ends[k] - size[k] + SLICE_BYTES, side="right"))
            end = min(max(end, k + 1), k + SLICE_ROWS)
            yield batch.slice(k, end - k)
            k = end


def chunks(
    batches: Iterator[pa.RecordBatch], hashes: WordHashes, most: int, wanted: Callable | None = None
) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, lengths, tokens) of some whole documents at a time, of those whose id is ``wanted``."""
    ids, sizes, parts, total = [], [], [], 0
    for part in slices(batches):
        if wanted:
            part = part.filter(pa.array([wanted(i) for i in part.column(0).to_pylist()], pa.bool_()))
        if part.num_rows == 0:
            continue
        lengths, tokens = token_hashes(part.column(1), hashes)
        ids += part.column(0).to_pylist()
        sizes.append(lengths)
        parts.append(tokens)
        total += len(tokens)
        if total >= most:
            yield ids, np.concatenate(sizes), np.concatenate(parts)
            ids, sizes, parts, total = [], [], [], 0
    if ids:
        yield ids, np.concatenate(sizes), np.concatenate(parts)


def prefix(h: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of hashes, as a number."""
    return h >> np.uint64(64 - bits) if bits else np.zeros_like(h)


def packed(by: np.ndarray, **columns: np.ndarray) -> dict[str, pa.Array]:
    """Per run of equal numbers ``by``, each column's values as the bytes of one row."""
    ends = np.flatnonzero(np.append(by[1:] != by[:-1], True)) + 1
    out = {"at": pa.array(by[ends - 1].astype(np.int64))}
    for name, values in columns.items():
        offsets = pa.py_buffer(np.append(0, ends * values.itemsize).astype(np.int32))
        out[name] = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(values)])
    return out


def unpacked(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def text_size(docs: DataFrame) -> tuple[int, int]:
    """(bytes of text, rows)"""
    size = docs.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    return size[0] or 0, size[1]


def range_bits(size: int) -> int:
    """Bits of the hash such that a range holds the grams of about RANGE_BYTES of text."""
    return (size // RANGE_BYTES).bit_length()


def gram_counts(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """(kind, h, n): 0 words, 1 bigrams of the training rows, of all corpus rows but the held-out fold."""
    bits = range_bits(text_size(docs)[0])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, tokens in chunks(batches, WordHashes(), COUNT_TOKENS, lambda i: not is_held_out(i, folds, fold)):
            for kind, grams in ((0, tokens), (1, pair_hash(before(tokens), tokens))):
                h, n = np.unique(grams, return_counts=True)
                rows = packed(prefix(h, bits), h=h, n=n.astype(np.int64))
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(rows["at"]), kind, np.int8)), **rows})

    def summed(table: pa.Table) -> pa.Table:
        h, n = unpacked(table, "h", np.uint64), unpacked(table, "n", np.int64)
        # a merge: each chunk's hashes are in order
        order = np.argsort(h, kind="stable")
        h = h[order]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        kind = np.full(len(starts), table.column("kind")[0].as_py(), np.int8)
        return pa.table({"kind": kind, "h": h[starts].view(np.int64), "n": np.add.reduceat(n[order], starts)})

    chunk_counts = docs.mapInArrow(counted, "kind byte, at long, h binary, n binary")
    return chunk_counts.groupBy("kind", "at").applyInArrow(summed, "kind byte, h long, n long")


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def levels_of(n: np.ndarray, step: int) -> np.ndarray:
    """floor(log2 n) // step, exactly."""
    return (np.frexp(n.astype(np.float64))[1] - 1) // step


def lines(h: np.ndarray, level: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of the line of 64 bytes, hash that gives the probes in it) for one level."""
    m = mix(h + np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64)))
    part = (h >> np.uint64(shift)) if shift < 64 else np.zeros_like(h)
    return ((part * np.uint64(LINES) + (m & np.uint64(LINES - 1))) << np.uint64(6)).view(np.int64), m


def probe(line: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte number, bit in the byte) of probe ``k``."""
    bit = (m >> np.uint64(16 + 9 * k)) & np.uint64(511)
    return line + (bit >> np.uint64(3)).view(np.int64), (bit & np.uint64(7)).astype(np.uint8)


def read_levels(h: np.ndarray, filter_bytes: np.ndarray, shift: int, first: int = 1, begin: int = 0) -> np.ndarray:
    """The level of each gram: ask for ``first``, ``first`` + 1, ... until one is missing.

    ``filter_bytes`` are those of the filter from byte ``begin`` on. A probe is made for those grams
    only that no probe before has found missing.
    """
    found = np.full(len(h), first - 1, np.int64)
    left, own, level = np.arange(len(h)), h, first
    while len(left):
        line, m = lines(own, level, shift)
        line -= begin
        for k in range(PROBES):
            at, bit = probe(line, m, k)
            hit = np.flatnonzero((filter_bytes.take(at) >> bit) & 1)
            if len(hit) < len(left):
                left, own, line, m = left[hit], own[hit], line[hit], m[hit]
        found[left] = level
        level += 1
    return found


def typical_count(level: np.ndarray) -> np.ndarray:
    """A count for a level: the middle of its range on a log scale; 1 for level 0, 0 for unknown grams."""
    return np.where(level > 0, 2.0 ** (level + 0.5), level + 1.0)


def entries_of(per_level: dict[int, int], step: int, first: int) -> int:
    return sum((k // step + 1 - first) * n for k, n in per_level.items())


def part_bits(entries: int) -> int:
    return max(0, -(-entries * BITS_PER_ENTRY // (PART_BYTES * 8)) - 1).bit_length()


def most_entries(size: int, rows: int) -> int:
    """No text of ``size`` bytes in ``rows`` rows has grams of more entries.

    A gram that occurs n times has at most n entries. Each token but the end of a row takes two bytes
    or is the last one, and starts a word and a bigram.
    """
    return size + 3 * rows


def set_levels(out: np.ndarray, h: np.ndarray, level: np.ndarray, shift: int, first: int, begin: int) -> None:
    """Enter grams in ``out``, the bytes of the filter from byte ``begin`` on."""
    for k in range(first, int(level.max(initial=0)) + 1):
        line, m = lines(h[level >= k], k, shift)
        for j in range(PROBES):
            at, bit = probe(line - begin, m, j)
            np.bitwise_or.at(out, at, np.uint8(1) << bit)


def filter_parts(counts: DataFrame, bits: int, step: int, first: int) -> DataFrame:
    """(part, bytes) of all parts that hold anything."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per part for some grams at a time: their hashes and levels."""
        for table in gathered(batches, PART_ROWS):
            h = table.column("h").to_numpy().view(np.uint64)
            level = levels_of(table.column("n").to_numpy(), step).astype(np.uint8)
            part = prefix(h, bits)
            order = np.argsort(part, kind="stable")
            yield pa.RecordBatch.from_pydict(packed(part[order], h=h[order], level=level[order]))

    def built(table: pa.Table) -> pa.Table:
        h, level = unpacked(table, "h", np.uint64), unpacked(table, "level", np.uint8)
        part = table.column("at")[0].as_py()
        out = np.zeros(PART_BYTES, np.uint8)
        set_levels(out, h, level, 64 - bits, first, part * PART_BYTES)
        return pa.table({"part": [part], "bytes": pa.array([out.tobytes()], pa.binary())})

    kept = counts.filter(F.col("n") >= 2 ** (step * first)).select("h", "n")
    rows = kept.mapInArrow(cut, "at long, h binary, level binary")
    return rows.groupBy("at").applyInArrow(built, "part long, bytes binary")


def log_filter(
    counts: DataFrame, per_level: dict[int, int], max_parts: int, first: int = 1
) -> tuple[np.ndarray, int, int]:
    """The filter as bytes, the shift that gives the part of a hash, and the step of the levels."""
    step = 1
    while entries_of(per_level, step, first) * BITS_PER_ENTRY > max_parts * PART_BYTES * 8:
        step += 1
    bits = part_bits(entries_of(per_level, step, first))
    # at most max_parts rows of 128 KB
    parts = filter_parts(counts, bits, step, first).toArrow()
    whole = np.zeros(PART_BYTES << bits, np.uint8)
    for p, raw in zip(parts.column("part").to_pylist(), parts.column("bytes").to_pylist()):
        whole[p * PART_BYTES : (p + 1) * PART_BYTES] = np.frombuffer(raw, np.uint8)
    return whole, 64 - bits, step


# --- chunks and ranges: a filter that is too large to be sent ------------------------------


def planes(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of rows of ``size`` numbers: in each row all lowest bytes first, then all second ones, ..."""
    width, per_value = values.itemsize, np.repeat(size, size)
    at = np.arange(len(values)) + (width - 1) * np.repeat(np.cumsum(size) - size, size)
    raw, out = values.view(np.uint8).reshape(-1, width), np.empty(values.nbytes, np.uint8)
    for k in range(width):
        out[at] = raw[:, k]
        at += per_value
    return out


def from_planes(raw: np.ndarray, size: np.ndarray, dtype: type) -> np.ndarray:
    width, per_value = np.dtype(dtype).itemsize, np.repeat(size, size)
    out = np.empty((len(per_value), width), np.uint8)
    at = np.arange(len(per_value)) + (width - 1) * np.repeat(np.cumsum(size) - size, size)
    for k in range(width):
        out[:, k] = raw[at]
        at += per_value
    return out.reshape(-1).view(dtype)


def steps(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Unsigned numbers as differences to the one before in their row, of rows that have any."""
    out, first = values.copy(), np.cumsum(size) - size
    out[1:] -= values[:-1]
    out[first] = values[first]
    return out


def from_steps(differences: np.ndarray, size: np.ndarray) -> np.ndarray:
    total, first = np.cumsum(differences, dtype=differences.dtype), np.cumsum(size) - size
    return total - np.repeat(total[first] - differences[first], size)


def binaries(raw: np.ndarray, size: np.ndarray) -> pa.Array:
    """Rows of ``size`` bytes each."""
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def bytes_of(table: pa.Table, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, numbers of ``width`` bytes in each)."""
    size = pc.binary_length(table.column(name)).to_numpy().astype(np.int64) // width
    return unpacked(table, name, np.uint8), size


def one_row(values: np.ndarray) -> bytes:
    """Numbers compressed; shuffles and tables compress without coding by frequency, which halves these."""
    raw = planes(values, np.array([len(values)]))
    return raw.nbytes.to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def numbers(row: bytes, dtype: type) -> np.ndarray:
    """What ``one_row`` packed."""
    size = int.from_bytes(row[:8], "little")
    raw = np.frombuffer(pa.decompress(memoryview(row)[8:], size, codec="zstd"), np.uint8)
    return from_planes(raw, np.array([size // np.dtype(dtype).itemsize]), dtype)


def one_row_steps(values: np.ndarray) -> bytes:
    return one_row(steps(values, np.array([len(values)])))


def numbers_of_steps(raw: bytes, dtype: type) -> np.ndarray:
    differences = numbers(raw, dtype)
    return from_steps(differences, np.array([len(differences)]))


def bigrams(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different bigrams in order, which of them each token ends)."""
    return np.unique(pair_hash(before(tokens), tokens), return_inverse=True)


CHUNK = "ids array<long>, lengths binary, held binary, words binary, token binary"


def numbered_words(tokens: np.ndarray) -> list[bytes]:
    """Tokens as small numbers: the different ones, frequent ones first and equally frequent ones in order,
    as which each occurs."""
    words, token, n = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    number = np.empty(len(words), np.uint32)
    number[order] = np.arange(len(words), dtype=np.uint32)
    return [one_row_steps(words[order]), one_row(number[token])]


def words_and_tokens(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(the different words in order, which of them each token is)"""
    words = numbers_of_steps(row["words"], np.uint64)
    order = np.argsort(words)
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    return words[order], number[numbers(row["token"], np.uint32)]


def text_chunks(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """(chunk, CHUNK): the documents as numbers of their chunk's different words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, tokens in chunks(batches, WordHashes(), CHUNK_TOKENS):
            held = np.array([is_held_out(i, folds, fold) for i in ids])
            row = [lengths.astype(np.int32).tobytes(), held.tobytes(), *numbered_words(tokens)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in row)],
                [x.split()[0] for x in CHUNK.split(", ")],
            )

    return docs.mapInArrow(cut, CHUNK).withColumn("chunk", F.monotonically_increasing_id())


RANGE = "at long, n_words long, h binary, n binary, chunk binary, size binary, words binary, place binary"


def gram_ranges(cut: DataFrame, bits: int, turn: int, turns: int) -> DataFrame:
    """(RANGE) of every ``turns``-th range of hashes: its different grams, words first, how often the training rows
    have them, and for each chunk the places of its grams among them: how many, how many words, and where."""

    def moving(h: np.ndarray) -> np.ndarray:
        return prefix(h, bits) % np.uint64(turns) == turn

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, token = words_and_tokens(row)
                taught = np.repeat(~np.frombuffer(row["held"], bool), np.frombuffer(row["lengths"], np.int32))
                n_words = np.bincount(token[taught], minlength=len(words))
                tokens, own = words[token], moving(words)
                words, n_words = words[own], n_words[own]
                pairs = pair_hash(before(tokens), tokens)
                own = moving(pairs)
                pairs, at_pair = np.unique(pairs[own], return_inverse=True)
                n_pairs = np.bincount(at_pair[taught[own]], minlength=len(pairs))
                h, n = np.concatenate([words, pairs]), np.concatenate([n_words, n_pairs]).astype(np.uint32)
                if len(h) == 0:
                    continue
                at = prefix(h, bits)
                order = np.argsort(at, kind="stable")
                at = at[order]
                starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                size = np.diff(np.append(starts, len(at)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "at": pa.array(at[starts].astype(np.int64)),
                        "chunk": pa.array(np.full(len(starts), row["chunk"])),
                        "words": pa.array(np.add.reduceat((order < len(words)).astype(np.int64), starts)),
                        "h": binaries(planes(steps(h[order], size), size), 8 * size),
                        "n": binaries(planes(n[order], size), 4 * size),
                    }
                )

    def summed(table: pa.Table) -> pa.Table:
        raw, size = bytes_of(table, "h", 8)
        h = from_steps(from_planes(raw, size, np.uint64), size)
        n = from_planes(bytes_of(table, "n", 4)[0], size, np.uint32)
        words = table.column("words").to_numpy()
        is_word = np.arange(len(h)) < np.repeat(np.cumsum(size) - size + words, size)
        place, lists, sums, done = np.empty(len(h), np.uint32), [], [], 0
        for own in (np.flatnonzero(is_word), np.flatnonzero(~is_word)):
            # a merge: each chunk's hashes are in order
            own = own[np.argsort(h[own], kind="stable")]
            new = np.append(True, h[own][1:] != h[own][:-1])[: len(own)]
            place[own] = np.cumsum(new) - 1 + done
            starts = np.flatnonzero(new)
            lists.append(h[own][starts])
            sums.append(np.add.reduceat(n[own].astype(np.int64), starts) if len(own) else np.zeros(0, np.int64))
            done += len(starts)
        row = [
            one_row_steps(np.concatenate(lists)),
            one_row(np.concatenate(sums)),
            table.column("chunk").to_numpy().astype(np.int64).tobytes(),
            size.astype(np.int32).tobytes(),
            words.astype(np.int32).tobytes(),
            one_row_steps(place),
        ]
        names = [x.split()[0] for x in RANGE.split(", ")]
        return pa.table([table.column("at")[:1], pa.array([len(lists[0])]), *(pa.array([x], pa.binary()) for x in row)], names)

    sent = cut.select("chunk", "lengths", "held", "words", "token").mapInArrow(
        asked, "at long, chunk long, words long, h binary, n binary"
    )
    return sent.groupBy("at").applyInArrow(summed, RANGE)


def range_counts(ranges: DataFrame) -> DataFrame:
    """(kind, h, n) of the grams that the training rows have."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, n = numbers_of_steps(row["h"], np.uint64), numbers(row["n"], np.int64)
                kind = (np.arange(len(h)) >= row["n_words"]).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[n > 0]) for x in (kind, h.view(np.int64), n)], ["kind", "h", "n"]
                )

    return ranges.select("n_words", "h", "n").mapInArrow(listed, "kind byte, h long, n long")


def level_sizes(ranges: DataFrame) -> DataFrame:
    """(kind, k, grams, tokens): per level, how many grams there are and how often they occur."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = numbers(row["n"], np.int64)
                for kind, own in enumerate((n[: row["n_words"]], n[row["n_words"] :])):
                    own = own[own > 0]
                    k, at = np.unique(levels_of(own, 1), return_inverse=True)
                    tokens = np.zeros(len(k), np.int64)
                    np.add.at(tokens, at, own)
                    columns = np.full(len(k), kind, np.int8), k.astype(np.int32), np.bincount(at, minlength=len(k)), tokens
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "k", "grams", "tokens"])

    found = ranges.select("n_words", "n").mapInArrow(counted, "kind byte, k int, grams long, tokens long")
    return found.groupBy("kind", "k").agg(F.sum("grams").alias("grams"), F.sum("tokens").alias("tokens"))


def word_count(ranges: DataFrame, word: int, bits: int) -> int:
    """How often the training rows have a word."""
    found = ranges.filter(F.col("at") == int(prefix(np.array([word], np.uint64), bits)[0]))
    for row in found.select("n_words", "h", "n").toArrow().to_pylist():
        h = numbers_of_steps(row["h"], np.uint64)[: row["n_words"]]
        return int(numbers(row["n"], np.int64)[: len(h)][h == np.uint64(word)].sum())
    return 0


ANSWER = "chunk long, at long, n binary, level binary"


def answers(ranges: DataFrame, bits: int, of_range: int) -> DataFrame:
    """(ANSWER): per chunk and range the exact counts of the chunk's words and the levels of its grams, read from
    the filter of 2**``bits`` parts. A range of ``of_range`` bits holds whole parts, or a part holds whole ranges."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, n = numbers_of_steps(row["h"], np.uint64), numbers(row["n"], np.int64)
                if bits >= of_range:
                    begin = row["at"] * (PART_BYTES << (bits - of_range))
                    own = np.zeros(PART_BYTES << (bits - of_range), np.uint8)
                    set_levels(own, h[n > 0], levels_of(n[n > 0], 1), 64 - bits, 0, begin)
                else:
                    begin = (row["at"] >> (of_range - bits)) * PART_BYTES
                    own = np.frombuffer(row["bytes"] or bytes(PART_BYTES), np.uint8)
                level = read_levels(h, own, 64 - bits, 0, begin).astype(np.int8)
                place = numbers_of_steps(row["place"], np.uint32)
                size, words = (np.frombuffer(row[x], np.int32).astype(np.int64) for x in ("size", "words"))
                is_word = np.arange(len(place)) < np.repeat(np.cumsum(size) - size + words, size)
                chunk = np.frombuffer(row["chunk"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chunk),
                        pa.array(np.full(len(chunk), row["at"])),
                        binaries(planes(n[place[is_word]], words), 8 * words),
                        binaries(level[place], size),
                    ],
                    [x.split()[0] for x in ANSWER.split(", ")],
                )

    if bits < of_range:
        parts = filter_parts(range_counts(ranges), bits, 1, 0)
        ranges = ranges.withColumn("part", F.shiftright("at", of_range - bits)).join(parts.hint("merge"), "part", "left")
    return ranges.mapInArrow(answered, ANSWER)


SCORED = (
    "doc_id long, held_out boolean, n_tokens long, head_known long, head_score double, "
    "tail_h array<long>, tail_n array<long>, score double"
)


OUT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score_texts(
    docs: DataFrame,
    folds: int = 7,
    fold: int = 2,
    bigram_weight: float = 0.1,
    max_parts: int = 1024,
    head_words: int = 1 << 20,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    source = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    size, rows = text_size(source)
    if 1 << part_bits(most_entries(size, rows)) > max_parts:
        return score_in_ranges(source, folds, fold, bigram_weight, range_bits(size))
    return score_by_broadcast(source, folds, fold, bigram_weight, max_parts, head_words)


class Model(NamedTuple):
    """What scores need beside the filter."""

    n_train: int
    n_words: int
    n_starts: int
    bigram_weight: float

    @property
    def log_all(self) -> float:
        return float(np.log10(self.n_train + self.n_words + 1))

    def scores(self, doc: np.ndarray, n_docs: int, tokens: np.ndarray, count_w: np.ndarray, count_vw: np.ndarray) -> np.ndarray:
        """Per document the sum over its tokens, of whose words and bigrams counts were read from the filter."""
        first = before(tokens) == np.uint64(START)
        count_v = np.where(first, self.n_starts, np.append(1.0, count_w[:-1]))
        unigram = (count_w + 0.5) / (self.n_train + 0.5 * (self.n_words + 1))
        bigram = np.minimum(count_vw / np.maximum(count_v, 1.0), 1.0)
        p = (1 - self.bigram_weight) * unigram + self.bigram_weight * bigram
        return np.bincount(doc, np.log10(np.minimum(p, 1.0)), n_docs)


def score_in_ranges(source: DataFrame, folds: int, fold: int, bigram_weight: float, of_range: int) -> DataFrame:
    """Scores by a filter that stays in the ranges of the hash that set it."""
    spark = source.sparkSession
    with batch_bytes(spark, BATCH_BYTES):
        cut = stored(text_chunks(source, folds, fold), "lm-chunks")
        turns = min(TURNS, 1 << of_range)
        moved = [stored(gram_ranges(cut, of_range, turn, turns), "lm-ranges") for turn in range(turns)]
        ranges = reduce(DataFrame.unionByName, moved)
        sizes = level_sizes(ranges).collect()
        model = Model(
            sum(r.tokens for r in sizes if r.kind == 0),
            sum(r.grams for r in sizes if r.kind == 0),
            word_count(ranges, END, of_range) or 1,
            bigram_weight,
        )
        per_level: dict[int, int] = {}
        for r in sizes:
            per_level[r.k] = per_level.get(r.k, 0) + r.grams
        bits = part_bits(entries_of(per_level, 1, 0))

    def scored(chunk: pa.Table, told: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        words, token = words_and_tokens(row)
        lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        tokens, n_docs = words[token], len(lengths)
        pairs, at_pair = bigrams(tokens)
        # in the order of the ranges, words before bigrams: as the grams were sent
        told = told.take(pa.array(np.argsort(told.column("at").to_numpy())))
        order = np.argsort(prefix(np.concatenate([words, pairs]), of_range), kind="stable")
        level = np.empty(len(order), np.int8)
        level[order] = unpacked(told, "level", np.int8)
        count = typical_count(level)
        exact = from_planes(*bytes_of(told, "n", 8), np.int64)[token]
        doc = np.repeat(np.arange(n_docs), lengths)
        base = np.bincount(doc, np.log10(exact + 1.0) - model.log_all, n_docs)
        return pa.table(
            [
                pa.array(row["ids"], pa.int64()),
                pa.array(np.frombuffer(row["held"], bool)),
                pa.array(lengths),
                pa.array(np.bincount(doc, exact > 0, n_docs).astype(np.int64)),
                pa.array(np.full(n_docs, model.n_train, np.int64)),
                pa.array(base),
                pa.array(model.scores(doc, n_docs, tokens, count[: len(words)][token], count[len(words) :][at_pair])),
            ],
            [x.split()[0] for x in OUT.split(", ")],
        )

    with batch_bytes(spark, BATCH_BYTES):
        told = stored(answers(ranges, bits, of_range), "lm-answers")
        # each table goes as soon as the next one stands, as they take the disk
        release(*moved)
        result = stored(cut.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(scored, OUT), "lm-scores")
    release(cut, told)
    return result


def score_by_broadcast(
    source: DataFrame, folds: int, fold: int, bigram_weight: float, max_parts: int, head_words: int
) -> DataFrame:
    """Scores by a filter of at most ``max_parts`` parts that every task has."""
    with batch_bytes(source.sparkSession, BATCH_BYTES):
        counts = stored(gram_counts(source, folds, fold), "gram-counts")
    words = counts.filter("kind = 0")
    log2 = F.floor(F.log2("n") + 1e-9).cast("int")
    sizes = counts.groupBy("kind", log2.alias("k")).agg(F.count("*").alias("grams"), F.sum("n").alias("tokens")).collect()
    n_train = sum(r.tokens for r in sizes if r.kind == 0)
    n_words = sum(r.grams for r in sizes if r.kind == 0)
    n_starts = counts.filter((F.col("kind") == 0) & (F.col("h") == int(np.uint64(END).view(np.int64)))).first()
    n_starts = n_starts.n if n_starts else 1

    per_level: dict[int, int] = {}
    for r in sizes:
        per_level[r.k] = per_level.get(r.k, 0) + r.grams
    whole, shift, _ = log_filter(counts, per_level, max_parts, 0)
    model = Model(n_train, n_words, n_starts, bigram_weight)

    # the head: all words from the lowest power of two on, from which they fit
    cut, room = 0, head_words
    for r in sorted((r for r in sizes if r.kind == 0), key=lambda r: -r.k):
        room -= r.grams
        if room < 0:
            cut = r.k + 1
            break
    head = words.filter(F.col("n") >= 2**cut).select("h", "n").toArrow()
    head_h = head.column("h").to_numpy().view(np.uint64)
    order = np.argsort(head_h)
    shared = source.sparkSession.sparkContext.broadcast(
        (whole, head_h[order], head.column("n").to_numpy()[order].astype(np.int64))
    )
    log_all = model.log_all

    def told(ids: list, lengths: np.ndarray, tokens: np.ndarray, level_of: Callable) -> pa.RecordBatch:
        _, known_h, known_n = shared.value
        doc = np.repeat(np.arange(len(ids)), lengths)
        # each word and bigram is looked up once, in the order of the hashes, which is that of the filter's parts
        words, at_word = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(known_h, words), max(len(known_h) - 1, 0))
        found = known_h[at] == words if len(known_h) else np.zeros(len(words), bool)
        exact = np.where(found, known_n[at] if len(known_h) else 0, 0)
        base = np.bincount(doc, np.where(found, np.log10(exact + 1.0) - log_all, 0.0)[at_word], len(ids))
        hit = found[at_word]
        known = np.bincount(doc, hit, len(ids)).astype(np.int64)
        # what the head doesn't hold: per document its words with their numbers
        rest = np.flatnonzero(~hit)
        keys = np.lexsort((tokens[rest], doc[rest]))
        d, h = doc[rest][keys], tokens[rest][keys]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        starts = np.flatnonzero(new)
        times = np.diff(np.append(starts, len(h)))
        offsets = np.searchsorted(d[starts], np.arange(len(ids) + 1)).astype(np.int32)
        pairs, at_pair = bigrams(tokens)
        count_w, count_vw = typical_count(level_of(words))[at_word], typical_count(level_of(pairs))[at_pair]
        score = model.scores(doc, len(ids), tokens, count_w, count_vw)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([is_held_out(i, folds, fold) for i in ids]),
                pa.array(lengths.astype(np.int64)),
                pa.array(known),
                pa.array(base),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[starts].view(np.int64))),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int64))),
                pa.array(score),
            ],
            [x.split()[0] for x in SCORED.split(", ")],
        )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_bytes = shared.value[0]
        for ids, lengths, tokens in chunks(batches, WordHashes(), SCORE_TOKENS):
            yield told(ids, lengths, tokens, lambda h: read_levels(h, filter_bytes, shift, 0))

    found = source.mapInArrow(scored, SCORED)
    with batch_bytes(source.sparkSession, BATCH_BYTES):
        rows = stored(found.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    tail = rows.select("row", F.inline(F.arrays_zip("tail_h", "tail_n"))).join(
        words.filter(F.col("n") < 2**cut).select(F.col("h").alias("tail_h"), F.col("n").alias("c")), "tail_h", "left"
    )
    c = F.coalesce("c", F.lit(0))
    sums = tail.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("tail_n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("tail_n") * (F.log10(c + 1.0) - log_all)).alias("tail_score"),
    )
    out = rows.drop("tail_h", "tail_n").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"),
        "score",
    )
    result = stored(out, "lm-scores")
    release(counts, rows)
    return result

