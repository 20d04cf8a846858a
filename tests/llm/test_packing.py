import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from labelloom.llm import packing

ENCODER = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


SIGNS = ["a", "b", "é", "ß", "日", " ", "  ", "\n", "\t", " ", " ", "\u0085", "\x1c", "'", "s", "'ll", "1", "42", "!", "%%%", "<|endoftext|>", "Word.", "don't"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=14).map("".join))
def test_word_by_word_ids_are_the_tokenizers(tokenizer, text):
    assert np.frombuffer(ENCODER.text(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, docs, tokenizer, capacity):
    want = Counter()
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        bounds = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= capacity
    return len(filled)


def test_whole_table_round_trip(documents, texts, tokenizer):
    rows = packing.pack(documents).collect()
    used = check(rows, list(texts.items()), tokenizer, 2048)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_rows_and_small_sequences(odd, tokenizer):
    check(packing.pack(odd, capacity=64).collect(), [(r.doc_id, r.text) for r in odd.collect()], tokenizer, 64)


def test_empty_table(empty):
    assert packing.pack(empty).collect() == []


def test_the_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert bins.put(6) == (0, 0) and bins.put(7) == (1, 0)
    assert bins.put(8) == (2, 0)  # two bins are open: the one with 3 free places closes
    assert bins.put(3) == (0, 6) and bins.put(2) == (2, 8)
