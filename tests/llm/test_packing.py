"""Packing: ids by the library, gapless sequences, few of them, edge rows."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from montevar.llm import packing
from tests.llm.helpers import documents, prose, rng

TOK = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def whole_ids(text):
    return TOK.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, out, max_len=packing.MAX_LEN):
    want = sorted((str(i), k // max_len, k, len(ids[k:k + max_len]),
                   zlib.crc32(np.array(ids[k:k + max_len], dtype="<u4").tobytes()))
                  for i, t in rows for ids in [whole_ids(t)] for k in range(0, len(ids), max_len))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
    return len(by)


def test_ids_places_and_edge_rows(spark):
    r = rng(3)
    rows = [(1, "Hello world."), (2, None), (3, ""), (4, prose(r, 3000)), (4, "Hello world."), (None, "don't... É\n\n x"),
            (5, "a" * 60_000), (6, "word. " * 5000)] + [(10 + k, "same text here") for k in range(300)]
    docs = documents(spark, rows).withColumnRenamed("source", "sequence_id").withColumnRenamed("lang", "rank").repartition(5)
    out = packing.pack(docs).collect()
    n = check(rows, out)
    total = sum(x.length for x in out)
    assert n <= -(-total // packing.MAX_LEN) + 1
    assert packing.pack(docs.limit(0)).count() == 0


words = st.sampled_from(["a", "The", "foo.", ",", "..", "é", "É", "漢", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|", "|>", "'s", "don't", "Σ", "ΑΣ", "İ", "ß",
                         "½", "23", "\x00", " ", "\x85", "µ", "ª.", "-", "\t", "b.", "ʼn.", "é", "K."])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(words, st.sampled_from(["", " ", "\n", "  "])), max_size=8), min_size=1, max_size=4))
def test_words_have_the_ids_of_the_whole_text(texts):
    encode = packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER))
    texts = ["".join(a + b for a, b in t) for t in texts]
    for _ in range(2):                                              # unknown words, then remembered ones
        for text, ids in zip(texts, encode(texts)):
            assert np.frombuffer(ids, dtype="<u4").tolist() == TOK.encode(text, add_special_tokens=False).ids


def best_fit(lengths, max_len):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            k = min(fits, key=lambda j: free[j])
            free[k] -= n
        else:
            free.append(max_len - n)
    return len(free)


@pytest.mark.parametrize("seed", range(8))
def test_plan_on_counts_equals_best_fit_on_pieces(seed):
    r = rng(seed)
    lengths = r.integers(1, 65, int(r.integers(1, 400))).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    used, ranks = {}, {}
    for length, first, n, sequence, per, offset in packing.plan(counts, 64):
        for k in range(n):
            used.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
            ranks.setdefault(length, []).append(first + k)
    assert {n: sorted(v) for n, v in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) == best_fit(lengths, 64)


def test_plan_of_huge_counts_is_small():
    runs = packing.plan({n: 10**9 + n for n in range(1, 2049)})
    assert len(runs) < 20_000
