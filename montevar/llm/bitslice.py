"""Exact top-k inner products over a bit-sliced index.

Rows are cut into blocks.  In a block every quantised attribute is stored as bit
slices: slice ``b`` of attribute ``d`` is a bitmap over the block's rows.  A query's scores
are formed for all rows at once by bitmap arithmetic: each set bit of each weight adds
the attribute's slices at a shifted position, and carry-save adders reduce every
position to one slice.  The best rows are then selected from the most significant score slice
downwards; rows tied at the boundary are resolved exactly, by score and id.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from montevar.llm import common

SCALE = 256
BLOCK_ROWS = 32_768
#: Queries that one task holds beside one block.
SLOT_QUERIES = 2_048
#: Quantised components are whole numbers below this in size, so differences of two fit 64 bits.
MAX_LEVEL = 1 << 61


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors without null or non-finite components."""
    v = f"`{vector_col}`"
    return vectors.where(F.expr(
        f"`{id_col}` IS NOT NULL AND {v} IS NOT NULL AND forall({v}, x -> x IS NOT NULL AND NOT isnan(x) "
        "AND abs(x) < double('infinity'))")).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))


def quantise(x: np.ndarray, scale: int) -> np.ndarray:
    levels = np.floor(scale * x)
    if levels.size and np.abs(levels).max() >= MAX_LEVEL:
        raise ValueError(f"a component times {scale} has no 64-bit level: rescale the vectors")
    return levels.astype(np.int64)


def packed(levels: np.ndarray) -> bytes:
    """Levels as 32-bit numbers where all of the block are such, else as 64-bit ones."""
    narrow = not levels.size or -(1 << 31) <= levels.min() and levels.max() < 1 << 31
    return levels.astype("<i4" if narrow else "<i8").tobytes()


def unpacked(raw: bytes, n: int, dim: int) -> np.ndarray:
    kind = "<i8" if len(raw) > 4 * n * dim else "<i4"
    return np.frombuffer(raw, dtype=kind).reshape(n, dim).astype(np.int64)


def products(levels: np.ndarray, weights: np.ndarray) -> list[int]:
    """Exact inner products; one that leaves 64 bits is refused."""
    most = int(np.abs(levels).max(initial=0)) * int(np.abs(weights).max(initial=0)) * levels.shape[1]
    if most < 1 << 63:
        return (levels @ weights).tolist()
    out = [int(x) for x in levels.astype(object) @ weights.astype(object)]
    if any(not -(1 << 63) <= x < 1 << 63 for x in out):
        raise ValueError("a score leaves 64 bits: rescale the vectors")
    return out


def slices(levels: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps ``[attribute, bit, word]`` of ``levels - low`` over the rows, and ``low``."""
    rows, dim = levels.shape
    low = int(levels.min(initial=0))
    shifted = (levels - low).T                                     # attribute by row
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    words = -(-rows // 64)
    padded = np.zeros((dim, words * 64), dtype=np.int64)
    padded[:, :rows] = shifted
    planes = [np.packbits(((padded >> b) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")
              for b in range(bits)]
    return np.stack(planes, axis=1), low


def _signed_digits(x: int) -> list[tuple[int, int]]:
    """Non-adjacent form: (position, +1 or -1); about a third of the digits of plain binary."""
    out, at = [], 0
    while x:
        if x & 1:
            digit = 2 - (x & 3)
            out.append((at, digit))
            x -= digit
        x >>= 1
        at += 1
    return out


def add_up(index: np.ndarray, weights: np.ndarray, low: int) -> tuple[list[np.ndarray], int]:
    """Score slices, least significant first, and the constant to subtract from their value.

    A negative digit adds the complement of a slice: ``-s = (1 - s) - 1``.
    """
    columns: dict[int, list[np.ndarray]] = defaultdict(list)
    bits, constant = index.shape[1], -low * sum(weights.tolist())
    plus, minus = defaultdict(list), defaultdict(list)
    for attribute, weight in enumerate(weights.tolist()):
        for at, digit in _signed_digits(weight):
            (plus if digit > 0 else minus)[at].append(attribute)
    for at in set(plus) | set(minus):
        for b in range(bits):
            if plus[at]:
                columns[at + b].append(index[plus[at], b])
            if minus[at]:
                columns[at + b].append(~index[minus[at], b])
                constant += len(minus[at]) << (at + b)
    out, position = [], 0
    while columns:
        stack = columns.pop(position, None)
        if stack is None:
            out.append(np.zeros(index.shape[2], dtype=np.uint64))
        else:
            level = np.concatenate(stack)
            while len(level) > 1:
                third = len(level) // 3
                if third:                                          # full adders
                    a, b, c = level[:third], level[third:2 * third], level[2 * third:3 * third]
                    half = a ^ b
                    carry = (a & b) | (half & c)
                    level = np.concatenate([half ^ c, level[3 * third:]])
                else:                                              # half adder
                    carry = (level[:1] & level[1:])
                    level = level[:1] ^ level[1:]
                columns[position + 1].append(carry)
            out.append(level[0])
        position += 1
    return out, constant


def select_top(score: list[np.ndarray], eligible: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the ``k`` highest scores; of rows tied at the boundary those that come first."""
    sure, tied = np.zeros_like(eligible), eligible.copy()
    for plane in reversed(score):
        high = tied & plane
        if int(np.bitwise_count(sure | high).sum()) > k:
            tied = high
        else:
            sure |= high
            tied &= ~plane
    rows = [np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in (sure, tied)]
    return np.concatenate([rows[0], rows[1][:max(0, k - len(rows[0]))]])


def _blocks(scale: int, block_rows: int):
    def emit(ids: np.ndarray, x: np.ndarray) -> dict:
        order = np.argsort(ids, kind="stable")                     # so that boundary ties come by id
        return {"ids": ids[order].tobytes(), "levels": packed(quantise(x[order], scale)),
                "n": len(ids), "dim": x.shape[1]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)                  # vectors of one dimension share blocks

        def flush(dim: int, last: bool):
            # Up to twice block_rows, so that an uneven deal leaves no tiny block.
            while (n := sum(len(i) for i, _ in held[dim])) >= 2 * block_rows or last and n:
                ids, x = (np.concatenate(p) for p in zip(*held[dim]))
                cut = n if last and n < 2 * block_rows else block_rows
                held[dim] = [(ids[cut:], x[cut:])]
                yield pa.RecordBatch.from_pylist([emit(ids[:cut], x[:cut])], schema=pa.schema(
                    [("ids", pa.binary()), ("levels", pa.binary()), ("n", pa.int64()), ("dim", pa.int32())]))

        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            values, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                held[int(dim)].append((ids[own], values[ends[own][:, None] + np.arange(dim)]))
                yield from flush(int(dim), False)
        for dim in list(held):
            yield from flush(dim, True)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = SCALE, id_col: str = "vec_id",
          vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query.

    Components are quantised to ``floor(scale * x)``.  Candidates of a query are all rows with
    another id and the same dimension; fewer than ``k`` are all returned, ties go to the smaller id.
    Null ids, null vectors and vectors with null or non-finite components take no part, empty tables give
    an empty result.  Ids are whole numbers.  A component whose level, or a top row whose score, leaves 64 bits is an error.  A repeated candidate row is a candidate each time; a query id that occurs more
    than once is asked once, with its smallest vector.  Other columns are ignored.
    """
    rows = usable(vectors, id_col, vector_col)
    # A block per partition: round-robin dealing is even whatever the ids are.
    n_rows = rows.count()
    n_blocks = max(1, -(-n_rows // block_rows))
    blocks = rows.repartition(n_blocks).mapInArrow(
        _blocks(scale, block_rows), "ids binary, levels binary, n bigint, dim int")
    blocks = common.materialize(blocks.withColumn("block", F.spark_partition_id()), "bitslice")

    asked = common.checkpoint(usable(queries, id_col, vector_col).groupBy("vec_id").agg(
        F.min("embedding").alias("embedding")))
    n_slots = max(1, math.ceil(asked.count() / SLOT_QUERIES),
                  math.ceil(2 * vectors.sparkSession.sparkContext.defaultParallelism / n_blocks))
    # One task per (block, slot of queries): the query set meets all rows, in blocks.
    slot = F.pmod(F.xxhash64("vec_id"), F.lit(n_slots)).cast("int")
    spread = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))))
    sent = asked.withColumn("slot", slot).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": [], "vec_id": [], "score": []}
        for r in left.itertuples():
            ids = np.frombuffer(r.ids, dtype=np.int64)
            levels = unpacked(r.levels, r.n, r.dim)
            index, low = slices(levels)
            everyone = np.packbits(np.arange(index.shape[2] * 64) < r.n, bitorder="little").view("<u8")
            for query_id, x in zip(right["vec_id"], right["embedding"]):
                if len(x) != r.dim:
                    continue
                weights = quantise(np.asarray(x, dtype=np.float64), scale)
                eligible = everyone.copy()
                for own in range(np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, side="right")):
                    eligible[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
                score, _ = add_up(index, weights, low)
                best = select_top(score, eligible, k)
                found["query_id"] += [query_id] * len(best)
                found["vec_id"] += ids[best].tolist()
                found["score"] += products(levels[best], weights)
        return pd.DataFrame(found).astype("int64")

    found = (spread.groupBy("block", "slot").cogroup(sent.groupBy("block", "slot"))
             .applyInPandas(answer, "query_id bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op7(spark, sf_dir: str) -> DataFrame:
    """Contract query: 5 best rows of every vector whose id is divisible by 50."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
