"""Periodic runs of words by recursive frequency splitting.

A run of period q holds each of its words four times or more.  A word that occurs less often within the
current segment can be in no run, so it splits the segment; in the parts counts are lower and
further words fall out, until nothing changes.  Ordinary prose splits away entirely.  The segments that
survive are scanned lag by lag: a run of period q covers four multiples of q, so only every q-th position is
compared with the next ones, and stretches are extended from there.
"""

from __future__ import annotations

import zlib

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from montevar.llm.common import forget, portions, table

#: A run is this many words long at least, and this many times its period.
LEAST, TIMES = 6, 4
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def segments(ids: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int]]:
    """Surviving segments ``begin, end`` of word numbers ``ids``; ``owner`` (ascending) tells texts apart.

    Each round counts the words of every segment that the last round changed and cuts it at those met fewer
    than ``TIMES`` times.
    """
    at, seg = np.arange(len(ids)), owner
    while len(at):
        _, seg = np.unique(seg, return_inverse=True)
        words = int(ids.max()) + 1
        codes = pd.factorize(seg.astype(np.int64) * words + ids[at])[0]
        often = np.bincount(codes)[codes] >= TIMES
        changed = np.zeros(int(seg[-1]) + 1, dtype=bool)
        changed[seg[~often]] = True
        # A stable segment is whole: its positions follow each other.
        stable = ~changed[seg]
        if stable.any():
            first = np.flatnonzero(np.diff(seg, prepend=-1) != 0)
            last = np.append(first[1:], len(seg)) - 1
            for a, b in zip(first[stable[first]].tolist(), last[stable[first]].tolist()):
                yield int(at[a]), int(at[b]) + 1
        keep = often & ~stable
        at, seg = at[keep], seg[keep]
        if len(at):
            new = np.cumsum((np.diff(at, prepend=at[0]) != 1) | (np.diff(seg, prepend=seg[0]) != 0))
            long_enough = np.bincount(new)[new] >= LEAST
            at, seg = at[long_enough], new[long_enough]


def _reach(ids: np.ndarray, q: int, x: int, step: int, bound: int) -> int:
    """How many positions from ``x`` on (forwards or backwards) equal those ``q`` later, ``bound`` at most."""
    done, width = 0, 32
    while done < bound:
        n = min(width, bound - done)
        lo = x + done if step > 0 else x - done - n + 1
        same = ids[lo:lo + n] == ids[lo + q:lo + q + n]
        if step < 0:
            same = same[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, width = done + n, width * 2
    return done


def scan(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``start, length, period`` within one segment, ascending by period."""
    n, runs, seen, periods = len(ids), [], set(), np.zeros(0, dtype=np.int64)
    run_of = np.full(n, -1)
    for q in range(1, n // TIMES + 1):
        marks = ids[::q]
        same = marks[1:] == marks[:-1]
        # A stretch that equals itself q later is 3q long at least, so it holds three such marks in a row.
        hits = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * q
        if len(hits) and runs:
            # Inside a run whose period divides q, this lag finds that run again.
            r = run_of[hits]
            inside = (r >= 0) & (r == run_of[hits + q])
            if len(periods) < len(runs):
                periods = np.array([p for _, _, p in runs])
            hits = hits[~(inside & (q % periods[r] == 0))]
        end = 0
        for x in hits.tolist():
            if x < end:
                continue
            back = _reach(ids, q, x, -1, x + 1)
            ahead = _reach(ids, q, x, 1, n - q - x)
            start, length = x - back + 1, back - 1 + ahead + q
            end = x + ahead
            if length >= max(LEAST, TIMES * q) and (start, length) not in seen:
                seen.add((start, length))
                run_of[start:start + length] = len(runs)
                runs.append((start, length, q))
    return runs


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts end to end, and the text of each."""
    flat = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
    return flat.indices.to_numpy().astype(np.int64), owner


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  edit: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``.

    Words are what stands between ASCII white space, numbered from 0.  ``runs`` holds every run
    ``start, length, period`` by start, then period: a stretch with smallest period q, six words and 4q
    long at least, that no neighbour extends.  ``collapsed`` is the text without the words that a run holds after its
    first period, joined by one space.  ``edit`` may change the words of a text, given its id, before the search.

    Null and empty texts have no words, no runs and an empty ``collapsed``; rows with null or repeated ids stand for
    themselves; an empty table gives an empty result.  Whole texts of any length are taken.  Other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (part for whole in batches for part in portions(whole, "text")):
            names = batch.column("doc_id").to_pylist()
            texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in batch.column("text")]
            if edit is not None:
                texts = [edit(name, words) for name, words in zip(names, texts)]
            ids, owner = _numbered(texts)
            begins = np.cumsum([0, *(len(words) for words in texts)])
            found = [[] for _ in texts]
            for a, b in segments(ids, owner):
                k = int(owner[a])
                found[k] += [{"start": a - int(begins[k]) + s, "length": n, "period": q} for s, n, q in scan(ids[a:b])]
            collapsed = []
            for words, of in zip(texts, found):
                of.sort(key=lambda r: (r["start"], r["period"]))
                if of:
                    keep = np.ones(len(words), dtype=bool)
                    for r in of:
                        keep[r["start"] + r["period"]:r["start"] + r["length"]] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(words) for words in texts], pa.int64()),
                 pa.array(found, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return src.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUN}, collapsed string")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change: one text in ten, by the CRC-32 of its id, ends in repeats of one stretch."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def op12(spark, sf_dir: str) -> DataFrame:
    """Contract query: number of runs, the run of greatest exponent, and digests of all runs and of the collapsed text."""
    out = periodic_runs(table(spark, sf_dir, "documents"), edit=repeated_tail)
    # Exponents are compared exactly: a / b > c / d where a d > c b.
    first = F.expr("""element_at(array_sort(runs, (x, y) -> CASE
        WHEN x.length * y.period > y.length * x.period THEN -1 WHEN x.length * y.period < y.length * x.period THEN 1
        WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1
        WHEN x.period < y.period THEN -1 WHEN x.period > y.period THEN 1 ELSE 0 END), 1)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return (out.withColumn("best", F.when(F.size("runs") > 0, first))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                    F.expr("(1000 * best.length) DIV best.period").alias("exponent_milli"),
                    F.sha2(F.encode(lines, "utf-8"), 256).alias("runs_sha256"),
                    F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"), "n_words"))
