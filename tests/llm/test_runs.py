"""Periodic runs: brute force on small alphabets, splitting, digests, edge rows."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from montevar.llm import runs
from tests.llm.helpers import documents, folder


def brute(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def changed(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None:
        words = changed(doc_id, words)
    found, keep = brute(words), [True] * len(words)
    for s, n, q in found:
        keep[s + q:s + n] = [False] * (n - q)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    return (len(found), *best, found and 1000 * best[1] // best[2] or None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for w, k in zip(words, keep) if k)).hexdigest())


def planted(rnd, n, letters):
    words = [rnd.randrange(letters) for _ in range(n)]
    for _ in range(rnd.randrange(4) if n else 0):
        p, a = rnd.randrange(1, 12), rnd.randrange(n)
        for i in range(a + p, min(n, a + p * rnd.randrange(3, 9))):
            words[i] = words[i - p]
    return words


def test_segments_and_scan_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(3000):
        words = planted(rnd, rnd.randrange(1, 90), rnd.choice([1, 2, 2, 3, 5, 9]))
        ids = np.array(words, dtype=np.int64)
        found = [(a + s, n, q) for a, b in runs.segments(ids, np.zeros(len(ids), dtype=np.int64)) for s, n, q in runs.scan(ids[a:b])]
        assert sorted(found, key=lambda r: (r[0], r[2])) == brute(words)


def test_prose_splits_away():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 20_000), 5000).astype(np.int64)
    assert sum(b - a for a, b in runs.segments(ids, np.zeros(len(ids), dtype=np.int64))) < len(ids) / 20


def test_texts_of_a_batch_are_kept_apart():
    ids, owner = runs._numbered([[b"a"] * 4, [], [b"a"] * 4, [b"a"] * 6])
    found = list(runs.segments(ids, owner))
    assert found == [(0, 4), (4, 8), (8, 14)]
    assert [runs.scan(ids[a:b]) for a, b in found] == [[], [], [(0, 6, 1)]]


@pytest.mark.parametrize("n", [50_000])
def test_one_long_run_is_scanned_quickly(n):
    assert runs.scan(np.zeros(n, dtype=np.int64)) == [(0, n, 1)]
    assert runs.scan(np.arange(n) % 7) == [(0, n, 7)]


def test_contract_query(spark, tmp_path):
    rnd = random.Random(7)
    seps = [" ", "\n", "\t", "  ", "\x0b", "\x0c\r"]
    rows = []
    for k in range(300):
        words = [f"wé{w}" if w else "W" for w in planted(rnd, rnd.randrange(80), rnd.choice([1, 2, 3, 6, 40]))]
        rows.append((k, rnd.choice(["", " "]) + "".join(w + rnd.choice(seps) for w in words)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "a b   " * 8), (None, "x " * 9), (None, "y " * 9),
             (5, "same id " * 7), (5, "same id " * 7), (1004, "one two three " * 20_000)]
    sf = folder(spark, tmp_path, documents=documents(spark, rows).repartition(3))
    out = runs.op12(spark, sf).collect()
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = sorted((str(r.doc_id), *map(str, (r[n] for n in names))) for r in out)
    small = [r for r in rows if r[0] != 1004]
    want = sorted((str(k), *map(str, expected(k, t))) for k, t in small)
    assert [r for r in got if r[0] != "1004"] == want
    long = next(r for r in out if r.doc_id == 1004)
    assert (long.n_runs, long.start, long.period) == (1, 0, 3) or zlib.crc32(b"1004") % 10 == 0


def test_empty_table(spark, tmp_path):
    assert runs.op12(spark, folder(spark, tmp_path, documents=documents(spark, []).coalesce(1))).count() == 0
