"""Repeated passages: paragraph MinHash banding, exact Jaccard, components.

A paragraph is a line of at least ``MIN_WORDS`` words.  Its five-word shingles are reduced to 30 minimum hashes in
10 bands of three rows: two paragraphs at Jaccard 0.8 collide in some band with probability
1 - (1 - 0.8^3)^10 = 0.9992.  Colliding paragraphs are verified by the exact Jaccard similarity of their shingle
sets and joined to components; every paragraph but the first of its component is a repeat.

Bands of one family of near copies hold thousands of paragraphs, so pairs within a band are never written out.  First every
member is compared with the first of its band.  Only bands in which the links found so far leave members in
different components are compared further, all with all, in blocks of bounded size inside tasks, which give back one
edge per linked paragraph.

A passage inside a longer line, wrapped over short lines or broken otherwise is found by ``passages``, which
looks at the word stream of the whole text: windows of ``WINDOW`` words are picked by their content alone (the smallest hash
among ``REACH`` neighbours), so any ``WINDOW + REACH - 1`` words that stand in two places share a picked window wherever
their lines break.  Every picked window that stands earlier elsewhere goes, and less than ``REACH`` words of
a passage stay at either of its ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from montevar.llm import common
from montevar.llm.common import Links, forget

MIN_WORDS = 25
SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
#: Paragraphs of a band that meet in one task at a time.
BLOCK = 2_048
#: Cells of an incidence matrix that is made and multiplied whole.
SMALL = 1 << 18
#: Words whose shingles are formed and reduced to minimum hashes at a time.
TOGETHER = 8_192
#: Words of a window of the word stream, and neighbouring windows of which the one of smallest hash is picked.
WINDOW, REACH = 25, 16
_MASK = (1 << 64) - 1


def _odd_numbers(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words_of(paragraph: str) -> list[str]:
    return paragraph.lower().split()


def digests(words: list[str]) -> np.ndarray:
    """A 64-bit digest of each word.  Digesting a word again costs less than looking it up among all words of a corpus."""
    digest = xxhash.xxh64_intdigest
    try:
        return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    except UnicodeEncodeError:                                      # half a surrogate pair
        return np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))


def lines_of(text: str) -> Iterator[tuple[int, str]]:
    """Start (in code points) and text of each line."""
    start = 0
    for line in text.split("\n"):
        yield start, line
        start += len(line) + 1


class Signer:
    """Band keys of paragraphs."""

    def __init__(self):
        self.powers = _odd_numbers(SHINGLE_WORDS, 5)
        self.factors = _odd_numbers(BANDS * ROWS, 7)[:, None]
        self.shifts = _odd_numbers(BANDS * ROWS, 11)[:, None]
        self.fold = _odd_numbers(ROWS, 13)
        self.band = _odd_numbers(BANDS, 17)

    def shingles(self, words: list[str]) -> np.ndarray:
        """A 64-bit digest of each shingle, in order."""
        h = digests(words)
        n = len(h) - SHINGLE_WORDS + 1
        shingles = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE_WORDS):
            shingles += h[k:k + n] * self.powers[k]
        return _mix(shingles)

    def shingles_of(self, paragraphs: list[list[str]]) -> list[np.ndarray]:
        """The shingles of each paragraph, formed over the words of all at once; those across two paragraphs are left out."""
        sizes = np.array([len(words) for words in paragraphs])
        if sizes.min() < SHINGLE_WORDS:
            raise ValueError(f"a paragraph has {SHINGLE_WORDS} words at least")
        flat = self.shingles([w for words in paragraphs for w in words])
        ends = np.cumsum(sizes)
        return [flat[a:b] for a, b in zip(ends - sizes, ends - SHINGLE_WORDS + 1)]

    def __call__(self, paragraphs: list[np.ndarray]) -> np.ndarray:
        """Band keys of paragraphs given by their shingles, one row each."""
        ends = np.cumsum([len(p) for p in paragraphs])
        starts, flat = ends - [len(p) for p in paragraphs], np.concatenate(paragraphs)
        low = np.full((len(self.factors), len(paragraphs)), _MASK, dtype=np.uint64)
        for at in range(0, len(flat), TOGETHER):                    # a bounded table also for a very long line
            part = flat[None, at:at + TOGETHER]
            first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, at + part.shape[1])
            cut = np.maximum(starts[first:last] - at, 0)
            found = np.minimum.reduceat(part * self.factors + self.shifts, cut, axis=1)
            low[:, first:last] = np.minimum(low[:, first:last], found)
        rows = _mix(low).T.reshape(len(paragraphs), BANDS, ROWS)
        return _mix((rows * self.fold).sum(axis=2, dtype=np.uint64) + self.band)


def shingle_set(text: str) -> set[tuple[str, ...]]:
    words = words_of(text)
    return set(zip(*(words[k:] for k in range(SHINGLE_WORDS))))


def similar(a: set, b: set, least: float = SIMILARITY) -> bool:
    """Exact Jaccard similarity of two shingle sets against the threshold."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def _paragraphs(docs: DataFrame, min_words: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, row_key bigint, line int, start bigint, n_chars bigint, p bigint, "
              "bands array<bigint>, paragraph string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sign = Signer()
        names = ["doc_id", "row_key", "line", "start", "n_chars", "p", "bands", "paragraph"]
        for batch in batches:
            ids, keys, texts = (batch.column(c) for c in ("doc_id", "row_key", "text"))
            rows: list[tuple] = []
            of: list[int] = []
            parts: list[list[str]] = []
            signed: list[np.ndarray] = []

            def emit():
                if parts:
                    signed.append(sign(sign.shingles_of(parts)))
                cols, bands = list(zip(*rows)), np.concatenate(signed).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(of)), keys.take(pa.array(of)), pa.array(cols[0], pa.int32()),
                     *(pa.array(c, pa.int64()) for c in cols[1:4]), lists, pa.array(cols[4], pa.string())], names)

            held = waiting = 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if not text:
                    continue
                for number, (start, line) in enumerate(lines_of(text)):
                    words = words_of(line)
                    if len(words) < min_words:
                        continue
                    h = xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
                    rows.append((number, start, len(line), h - (1 << 64) if h >> 63 else h, line))
                    parts.append(words)
                    of.append(i)
                    held += len(line)
                    waiting += len(words)
                    if waiting > TOGETHER:
                        signed.append(sign(sign.shingles_of(parts)))
                        parts, waiting = [], 0
                if held > 1 << 22:
                    yield emit()
                    rows, of, parts, signed, held, waiting = [], [], [], [], 0, 0
            if rows:
                yield emit()

    return docs.mapInArrow(run, schema)


def _shingled(texts: DataFrame) -> DataFrame:
    """``p, shingles``: the different shingles of each paragraph as ascending 64-bit digests (bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sign = Signer()
        for batch in batches:
            found: list[bytes] = []
            parts, waiting = [], 0
            for k, text in enumerate(batch.column("paragraph"), 1):
                parts.append(words_of(text.as_py()))
                waiting += len(parts[-1])
                if waiting > TOGETHER or k == batch.num_rows:
                    found += [np.unique(x).tobytes() for x in sign.shingles_of(parts)]
                    parts, waiting = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(found, pa.binary())], ["p", "shingles"])

    return texts.select("p", "paragraph").mapInArrow(run, "p bigint, shingles binary")


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Exact Jaccard similarity of two ascending arrays of different numbers against the threshold."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both >= least * (len(a) + len(b) - both)


def _verify(pairs: DataFrame, near: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` whose paragraphs are similar."""
    one = near.select(F.col("p").alias("a"), F.col("shingles").alias("of_a"))
    two = near.select(F.col("p").alias("b"), F.col("shingles").alias("of_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sides = [[np.frombuffer(x, dtype=np.uint64) for x in batch.column(c).to_pylist()] for c in ("of_a", "of_b")]
            keep = [alike(a, b, least) for a, b in zip(*sides)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a bigint, b bigint")


def numbered(sides: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], int]:
    """Rows of digests as rows of small numbers, one for each different digest, and how many there are."""
    flat = [np.concatenate(side) for side in sides]
    known, numbers = np.unique(np.concatenate(flat), return_inverse=True)
    numbers, at, out = numbers.astype(np.int32), 0, []
    for side in sides:
        cuts = at + np.cumsum([len(x) for x in side])
        out.append(np.split(numbers[at:cuts[-1]], cuts[:-1] - at))
        at = int(cuts[-1])
    return out, len(known)


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], n: int, least: float) -> Iterator[tuple]:
    """Row numbers of all pairs at the threshold, of rows of numbers below ``n``; some rows of ``left`` at a time.

    The sizes of the intersections are products of incidence matrices, made and multiplied in portions.
    """
    sizes = [np.array([len(s) for s in own]) for own in (left, right)]
    if (len(left) + len(right)) * n <= SMALL:                       # few short rows: one product
        every = np.zeros((len(left) + len(right), n), dtype=np.float32)
        every[np.repeat(np.arange(len(every)), np.concatenate(sizes)), np.concatenate([*left, *right])] = 1
        both = every[:len(left)] @ every[len(left):].T
        yield np.nonzero(both >= least * (sizes[0][:, None] + sizes[1] - both.astype(np.float64)))
        return
    rows = [np.repeat(np.arange(len(own)), size) for own, size in zip((left, right), sizes)]
    values = [np.concatenate(own) if own else np.zeros(0, dtype=np.int32) for own in (left, right)]
    shared = np.flatnonzero(np.bincount(values[0], minlength=n) * np.bincount(values[1], minlength=n))
    place = np.full(n, -1, dtype=np.int32)
    place[shared] = np.arange(len(shared), dtype=np.int32)
    for k in (0, 1):
        col = place[values[k]]
        rows[k], values[k] = rows[k][col >= 0], col[col >= 0]
    for lo in range(0, len(left), 128):
        both = np.zeros((min(128, len(left) - lo), len(right)), dtype=np.float32)
        for v in range(0, len(shared), 1024):
            parts = []
            for k, start, size in ((0, lo, len(both)), (1, 0, len(right))):
                own = (rows[k] >= start) & (rows[k] < start + size) & (values[k] >= v) & (values[k] < v + 1024)
                dense = np.zeros((size, 1024), dtype=np.float32)
                dense[rows[k][own] - start, values[k][own] - v] = 1
                parts.append(dense)
            both += parts[0] @ parts[1].T
        # Whole numbers up to 2^24 are exact in single precision; the comparison is in double.
        need = least * (sizes[0][lo:lo + len(both), None] + sizes[1] - both.astype(np.float64))
        x, y = np.nonzero(both >= need)
        yield x + lo, y


def _meet(least: float):
    """All links between different components of the two sides of each block, as one edge from each linked node to the least it reaches.

    The rows come sorted by block, many small blocks in a batch; a block that goes on in the next batch waits for it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        found = Links(np.dtype(np.int64))

        def blocks(rows: pa.Table, ends: list[int]) -> None:
            side, p, root = (rows.column(c).to_numpy() for c in ("side", "p", "root"))
            shingles, start = rows.column("shingles").slice(0, ends[-1]).to_pylist(), 0
            for end in ends:
                one, two = (start + np.flatnonzero(side[start:end] == s) for s in (0, 1))
                start = end
                if not len(one) or not len(two):
                    continue
                sets, n = numbered([[np.frombuffer(shingles[k], dtype=np.uint64) for k in own] for own in (one, two)])
                for x, y in similar_pairs(*sets, n, least):
                    a, b = one[x], two[y]
                    apart = root[a] != root[b]
                    found.add(p[a[apart]], p[b[apart]])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch])
            keys = [rows.column(c).to_numpy() for c in ("band", "i", "j")]
            ends = (np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1).tolist()
            if ends:
                blocks(rows, ends)
            held = rows.slice(ends[-1] if ends else 0).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            blocks(rows, [rows.num_rows])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.stars()], ["a", "b"])

    return run


def _still_apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``band, i, j, p, root, side``: what must meet of the bands whose members lie in different components.

    Only members of different components need be compared.  Of each band the largest component is one side only;
    the others (the small ones) are dealt to all blocks of the band, in blocks themselves.
    """
    placed = members.where("size > 2").join(roots, F.col("p") == F.col("node"), "left").select(
        "band", "p", "size", F.coalesce("root", "p").alias("root"))
    parts = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"))
    bands = (parts.groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("big"), F.max("k").alias("most"),
                                       F.sum("k").alias("n"), F.count(F.lit(1)).alias("roots"))
             .where("roots > 1")
             .select(F.col("band").alias("open"), "big", F.ceil(F.col("n") / BLOCK).cast("int").alias("n"),
                     F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("m")))
    left = (placed.join(bands, F.col("band") == F.col("open"))
            .withColumn("i", F.pmod(F.xxhash64("p"), F.col("n")).cast("int")).withColumn("j", F.pmod(F.xxhash64("p"), F.col("m")).cast("int")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = left.select("band", "i", each("m").alias("j"), "p", "root", F.lit(0).alias("side"))
    two = left.where("root <> big").select("band", each("n").alias("i"), "j", "p", "root", F.lit(1).alias("side"))
    return one.unionByName(two)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Every paragraph that has an equal or similar one.

    ``doc_id, row_key, line, start, n_chars, component_doc, component_line, removed``: where the paragraph
    lies (code points), the first paragraph of its component (by document id and line) and whether
    it repeats an earlier one.  ``row_key`` is a digest of the whole text, for rows that share an id.

    Null and empty texts and lines under ``min_words`` words have no paragraphs; rows without id
    come last; rows that repeat id and text are one document; an empty table gives an empty result;
    other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_key"),
                      F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    with common.Scratch(docs.sparkSession) as own:
        return own.result(_repeats(src, min_words, similarity), "repeats")


def _repeats(src: DataFrame, min_words: int, similarity: float) -> DataFrame:
    found = common.materialize(_paragraphs(src, min_words), "paragraphs")
    # Paragraphs of equal words are one node, numbered by 64 bits of their digest.
    keyed = found.groupBy("p").agg(F.first("bands").alias("bands")).select("p", F.explode("bands").alias("band"))
    first = (keyed.groupBy("band").agg(F.min("p").alias("lead"), F.count(F.lit(1)).alias("size"))
             .where("size > 1").withColumnRenamed("band", "of"))
    # Size estimates do not see what explode adds, so the planner might broadcast either side: both are shuffled.
    members = common.materialize(keyed.join(first.hint("merge"), F.col("band") == F.col("of")).select("band", "p", "lead", "size"), "bands")
    pairs = members.where("p <> lead").select(F.col("p").alias("a"), F.col("lead").alias("b")).distinct()
    wanted = members.select(F.col("p").alias("w")).distinct()
    near = common.materialize(_shingled(
        found.select("p", "paragraph").join(wanted, F.col("p") == F.col("w"), "left_semi")
        .groupBy("p").agg(F.first("paragraph").alias("paragraph"))), "colliding")
    roots = common.connected_components(_verify(pairs, near, similarity))

    # Bands of three and more members that are still apart; what they add joins the components found so far.
    more = (_still_apart(members, roots).join(near, "p").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
            .select("band", "i", "j", "side", "p", "root", "shingles").mapInArrow(_meet(similarity), "a bigint, b bigint"))
    roots = common.connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    where = found.select("doc_id", "row_key", "line", "start", "n_chars", "p")
    located = common.materialize(where.join(roots, F.col("p") == F.col("node"), "left").select(
        "doc_id", "row_key", "line", "start", "n_chars", F.coalesce("root", "p").alias("root")), "located")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("row_key").alias("row_key"),
                     F.col("line").alias("line"))
    heads = (located.select("root", place.alias("place")).distinct()
             .groupBy("root").agg(F.min("place").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(F.col("root").alias("r"), "head"))
    out = located.join(heads, F.col("root") == F.col("r")).withColumn("place", place)
    return out.select("doc_id", "row_key", "line", "start", "n_chars", F.col("head.doc_id").alias("component_doc"),
                      F.col("head.line").alias("component_line"), (F.col("place") != F.col("head")).alias("removed"))


class Windows:
    """Picked windows of a word stream: first word, 64-bit hash and a second one of 32 bits."""

    def __init__(self):
        self.bases = [int(b) for b in _odd_numbers(2, 19)]
        self.powers = np.ones((2, 2, 0), dtype=np.uint64)

    def _rolled(self, h: np.ndarray, k: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Sum of h[i + j] * base^j over each window (those ``at`` alone), from running sums and the powers of the inverse."""
        up, down = self.powers[k][:, :len(h)]
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * up, dtype=np.uint64)])
        n = len(h) - WINDOW + 1
        return _mix((sums[WINDOW:][at] - sums[:n][at]) * down[:n][at])

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(words) > self.powers.shape[2]:
            size = 2 * len(words)
            self.powers = np.array([[np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)], dtype=np.uint64)
                                     for b in (base, pow(base, -1, 1 << 64))] for base in self.bases])
        h = digests(words)
        all_of = self._rolled(h, 0)
        low, reach = all_of, min(REACH, len(all_of))
        size = 1
        while size < reach:                                         # smallest of each run of ``reach`` windows
            step = min(size, reach - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        padded = np.concatenate([np.zeros(reach - 1, dtype=np.uint64), low, np.zeros(reach - 1, dtype=np.uint64)])
        size = 1
        while size < reach:                                         # largest of the runs that a window is in
            step = min(size, reach - size)
            padded = np.maximum(padded[:-step], padded[step:])
            size += step
        at = np.flatnonzero(all_of == padded)
        return at, all_of[at].view(np.int64), (self._rolled(h, 1, at) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _windows(src: DataFrame) -> DataFrame:
    """Picked windows of each text, and the lines that they begin and end in."""
    kind = src.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "row_key", "word", "from_line", "to_line", "fp", "fp_more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        pick = Windows()
        for batch in batches:
            ids, keys, texts = (batch.column(c) for c in ("doc_id", "row_key", "text"))
            of, parts = [], []
            for i in range(batch.num_rows):
                lines = [line.lower().split() for line in texts[i].as_py().split("\n")]
                words = [w for line in lines for w in line]
                if len(words) < WINDOW:
                    continue
                at, fp, more = pick(words)
                line = np.repeat(np.arange(len(lines), dtype=np.int32), [len(own) for own in lines])
                parts.append((at.astype(np.int32), line[at], line[at + WINDOW - 1], fp, more))
                of.append(np.full(len(at), i))
            if parts:
                rows = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), keys.take(rows), *(pa.array(np.concatenate(c)) for c in zip(*parts))], names)

    return src.mapInArrow(run, f"doc_id {kind}, row_key bigint, word int, from_line int, to_line int, fp bigint, fp_more int")


def passages(docs: DataFrame, gone: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of ``WINDOW`` words that stand, word for word, in several places.

    ``doc_id, row_key, word, line, component_doc, component_word, removed``: the window's first word and its line, the
    first place it stands in, and whether it repeats that.  First is by document id (rows without id last), text digest
    and position.  Of a document, windows that overlap the first one do not count.  Windows that touch a line of
    ``gone`` (``doc_id, row_key, line``) are left out on both sides, so what a window repeats is never itself one of
    those lines.  Null texts have no windows; rows that repeat id and text are one document; an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_key"),
                      F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    with common.Scratch(docs.sparkSession) as own:
        return own.result(_passages(src, gone), "passages")


def _passages(src: DataFrame, gone: DataFrame | None) -> DataFrame:
    found = common.materialize(_windows(src), "windows")
    often = found.groupBy("fp", "fp_more").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("fp").alias("f"), F.col("fp_more").alias("g"))
    same = (F.col("fp") == F.col("f")) & (F.col("fp_more") == F.col("g"))
    met = found.join(often.hint("merge"), same, "left_semi")
    if gone is not None:
        lines = gone.groupBy(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).agg(
            F.collect_set("line").alias("__gone"))
        touched = F.exists("__gone", lambda line: line.between(F.col("from_line"), F.col("to_line")))
        met = met.join(lines, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__key")), "left").where(
            F.col("__gone").isNull() | ~touched)
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("row_key").alias("row_key"))
    met = common.materialize(met.select("doc_id", "row_key", "word", F.col("from_line").alias("line"), "fp", "fp_more"), "repeated-windows")
    where = F.struct(place.alias("place"), F.col("word"))
    # First and last place of each window, summed up before the shuffle; the join splits a window that stands in most documents.
    heads = (met.groupBy("fp", "fp_more").agg(F.min(where).alias("head"), F.max(where).alias("tail"))
             .where((F.col("tail.place") != F.col("head.place")) | (F.col("tail.word") >= F.col("head.word") + WINDOW))
             .select(F.col("fp").alias("f"), F.col("fp_more").alias("g"), "head"))
    removed = (place != F.col("head.place")) | (F.col("word") >= F.col("head.word") + WINDOW)
    every = met.join(heads.hint("merge"), same).withColumn("removed", removed)
    first = (place == F.col("head.place")) & (F.col("word") == F.col("head.word"))
    return every.where(F.col("removed") | first).select(
        "doc_id", "row_key", "word", "line", F.col("head.place.doc_id").alias("component_doc"),
        F.col("head.word").alias("component_word"), "removed").distinct()


_SPACED = re.compile(r"\S+")


def without(text: str, lines: list[int] | None, words: list[int] | None) -> str:
    """``text`` without the given lines and without the windows that begin at the given words.

    Of the white space around a removed window, the side with more line breaks stays.
    """
    cut = []
    if words:
        spans = [m.span() for m in _SPACED.finditer(text)]
        runs: list[list[int]] = []
        for w in sorted(words):
            if runs and w <= runs[-1][1]:
                runs[-1][1] = w + WINDOW
            else:
                runs.append([w, w + WINDOW])
        for first, end in runs:
            a, b = spans[first][0], spans[end - 1][1]
            before = spans[first - 1][1] if first else 0
            after = spans[end][0] if end < len(spans) else len(text)
            if first and (end == len(spans) or text.count("\n", before, a) < text.count("\n", b, after)):
                cut.append((before, b))
            else:
                cut.append((a, after))
    if lines:
        drop = set(lines)
        kept = [n for n in range(text.count("\n") + 1) if n not in drop]
        for n, (start, line) in enumerate(lines_of(text)):
            if n in drop:                                           # after the last kept line, the break before goes
                cut.append((start - 1 if kept and n > kept[-1] else start, start + len(line) + (not kept or n < kept[-1])))
    out, at = [], 0
    for a, b in sorted(cut):
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    return "".join(out) + text[at:]


def _removed_lines(found: DataFrame) -> DataFrame:
    return found.where("removed").select("doc_id", "row_key", "line").distinct()


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that repeat an earlier paragraph and without repeated ``passages`` of what is left;
    other columns stay as they are.

    A document that repeats as a whole keeps its row with an empty text.
    """
    lines = _removed_lines(repeats(docs, min_words, similarity, id_col, text_col))
    words = passages(docs, lines, id_col, text_col).where("removed").select("doc_id", "row_key", "word").distinct()
    gone = (lines.select("doc_id", "row_key", "line", F.lit(None).cast("int").alias("word"))
            .unionByName(words.select("doc_id", "row_key", F.lit(None).cast("int").alias("line"), "word"))
            .groupBy(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"))
            .agg(F.collect_set("line").alias("__lines"), F.collect_set("word").alias("__words")))
    joined = docs.join(gone, docs[id_col].eqNullSafe(F.col("__id")) & (
        F.xxhash64(docs[text_col]) == F.col("__key")), "left")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, lines: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without(t, *([] if x is None else list(x) for x in (n, w)))
                          for t, n, w in zip(texts, lines, words)], dtype=object)

    text = F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(rest(
        F.when(F.col("__lines").isNotNull(), F.col(text_col)), "__lines", "__words"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op3(spark, sf_dir: str) -> DataFrame:
    """Query: every repeated passage of the documents, where it first stands, and whether it goes.

    ``kind`` is ``paragraph`` (a line that has an equal or similar one: ``line, start, n_chars, component_line``) or ``passage``
    (a picked window of the word stream outside such lines: ``word, line, component_word``, each ``WINDOW`` words long).
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = repeats(docs)
    words = passages(docs, _removed_lines(lines))
    return lines.drop("row_key").withColumn("kind", F.lit("paragraph")).unionByName(
        words.drop("row_key").withColumn("kind", F.lit("passage")), allowMissingColumns=True)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without repeated passages; ``n_chars`` follows the text."""
    out = remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out

