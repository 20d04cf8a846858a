"""Best-fit packing of tokenized documents into sequences of a fixed length.

Texts are tokenized where they are read; only (id, piece, start, length, crc) goes on. Pieces are
dealt by hash over tasks of about ``TOKENS_PER_TASK`` tokens, and each task packs online: a fixed
number of open bins, a bit set of the free spaces that occur, the fullest bin that still takes a
piece gets it. When too many bins are open, the fullest one closes. A full bin closes at once. Of each
``AHEAD`` pieces that come, the longest are placed first.

A document longer than a sequence is cut into whole sequences; its first piece takes the rest.

Cases: a null or empty text is its end token alone, one piece. Rows that share a doc_id are packed
each on their own (``row`` tells them apart). Ties between bins of equal free space go to the last
opened. The same table always gives the same sequences, as pieces are sorted by hash before packing.
Strings of special tokens in a text are ordinary text. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import quoted, release, stored

TOKENS_PER_TASK = 1 << 26
OPEN_BINS = 1024
AHEAD = 2048
WORD_CACHE = 700_000
# A word of letters and the punctuation behind it, which the tokenizer's own pre-splitting cuts apart.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%&$#*|<>]*)")


class Crowded(Exception):
    """Blanks next to other white space: the text must be tokenized as a whole."""


class WordEncoder(dict):
    """Token ids as little-endian bytes, remembered per word with its leading blank.

    The tokenizer's own pre-splitting cuts before a blank that stands between two words, so the
    ids of " word" don't depend on its neighbours.
    """

    def __init__(self, tokenizer: str) -> None:
        super().__init__()
        self.marks: dict[str, bytes] = {"": b""}
        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def plain(self, text: str) -> bytes:
        return as_bytes(self.encoding.encode_ordinary(text))

    def __missing__(self, word: str) -> bytes:
        parts = PLAIN_WORD.fullmatch(word)
        if parts:
            letters, mark = parts.groups()
            if mark:
                ids = self[letters] + self.mark(mark)
            else:
                ids = as_bytes(self.encoding._encode_single_piece(" " + word))
        elif word == word.strip() != "":
            ids = self.plain(" " + word)
        else:
            raise Crowded
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = ids
        return ids

    def mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self.plain(mark)
        return self.marks[mark]

    def text(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or first != first.strip() or not first:
            return self.plain(text)
        try:
            return self.plain(first) + b"".join([self[w] for w in rest])
        except Crowded:
            return self.plain(text)


def as_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def cut(ids: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of 4-byte ids."""
    n = len(ids) // 4
    first = n % capacity or capacity
    bounds = [0, *range(min(first, n), n + 1, capacity)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """The pieces of every document; ``row`` is carried along."""
    end = end_id.to_bytes(4, "little")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            rows = []
            for row, i, t in zip(*[c.to_pylist() for c in batch.columns]):
                ids = encoder.text(t or "") + end
                for k, (start, n) in enumerate(cut(ids, capacity)):
                    rows.append((row, i, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PIECES.split(", ")]
            )

    return docs.mapInArrow(encoded, PIECES)


class OpenBins:
    """Bounded-space best fit over one stream of lengths."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most, self.open, self.made = capacity, most, 0, 0
        self.spaces = 0  # bit s is set when a bin with s free places is open
        self.bins: dict[int, list[int]] = {}

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        above = self.spaces >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins.setdefault(left, []).append(number)
            self.spaces |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        own = self.bins[free]
        number = own.pop()
        if not own:
            self.spaces &= ~(1 << free)
        self.open -= 1
        return number


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    tokenizer: str | None = None,
    end_id: int = 0,
    open_bins: int = OPEN_BINS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is a file of byte-pair ranks on every executor; by default the installed
    50k vocabulary, whose ids are those of byte_bpe_50k.json.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    # the hash of id and text gives equal rows equal numbers, which is all that order among them needs
    source = docs.select(
        F.xxhash64(quoted(doc_id), quoted(text)).alias("row"), quoted(doc_id).alias("doc_id"), quoted(text).alias("text")
    )
    pieces = stored(tokenized(source, capacity, tokenizer, end_id), "pieces")
    # a piece that fills a sequence needs no search
    full = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") < capacity)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // TOKENS_PER_TASK))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_pylist()
            at = [(0, 0)] * len(lengths)
            for first in range(0, len(lengths), AHEAD):
                window = range(first, min(first + AHEAD, len(lengths)))
                for k in sorted(window, key=lambda k: -lengths[k]):
                    at[k] = bins.put(lengths[k])
            numbers, offsets = zip(*at) if at else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())],
                [*batch.schema.names, "bin", "offset"],
            )

    mixed = rest.repartition(tasks, "row", "piece").sortWithinPartitions(F.xxhash64("row", "piece"), "row", "piece", "length")
    placed = mixed.mapInArrow(packed, PIECES + ", bin long, offset long").select(
        "*", F.spark_partition_id().cast("long").alias("part")
    )
    # a bin is numbered within its task; pieces that are a sequence alone count down from -1
    shared = placed.withColumn("sequence_id", F.shiftleft(F.col("part"), 40) + F.col("bin"))
    alone = full.withColumn("offset", F.lit(0).cast("long")).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = stored(shared.select(*columns).unionByName(alone.select(*columns)), "sequences")
    release(pieces)
    return out
