"""Helpers shared by the training-data operators: written tables, components, Arrow batches."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import montevar
from montevar.session import checkpoint_dir

# Functions travel with their code, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(montevar)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to a Python worker at a time while an operator writes its own tables.
BATCH_ROWS = 512


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts go to Python a few megabytes at a time, whatever the session's batch size; it is put back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables and broadcasts that nothing needs once a result has been written: they go when the block ends.

    ``with Scratch(spark) as own: ... return own.result(df, name)``: what ``materialize`` writes and ``share``
    broadcasts inside the block belongs to it; ``result`` writes a table that stays.
    """

    #: The blocks that are open in this thread, innermost last.
    _open: contextvars.ContextVar[tuple["Scratch", ...]] = contextvars.ContextVar("scratch", default=())

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.shared = spark, [], []

    def __enter__(self) -> "Scratch":
        self.token = Scratch._open.set((*Scratch._open.get(), self))
        return self

    @classmethod
    def innermost(cls) -> "Scratch | None":
        return (cls._open.get() or (None,))[-1]

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return self.spark.read.parquet(_written(df, name))

    def __exit__(self, *failed) -> None:
        Scratch._open.reset(self.token)
        for shared in self.shared:
            shared.destroy()
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        tidy(self.spark)


def _written(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage, so that Python work runs once however many consumers follow
    and a lost executor costs a re-read, never a recomputation.  Later scans read
    only the columns they need.  Inside a ``Scratch`` block the files go when the block ends; others are left to the
    clean-up policy of the folder.
    """
    path = _written(df, name)
    if (own := Scratch.innermost()) is not None:
        own.paths.append(path)
    return df.sparkSession.read.parquet(path)


def share(spark: SparkSession, value):
    """A broadcast; inside a ``Scratch`` block it is destroyed when the block ends."""
    shared = spark.sparkContext.broadcast(value)
    if (own := Scratch.innermost()) is not None:
        own.shared.append(shared)
    return shared


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _held() -> dict:
    """The holder is a module of the process, because functions that travel by value bring new globals along."""
    return sys.modules.setdefault("montevar_llm_held", types.SimpleNamespace(values={})).values


def per_process(name: str, key, make):
    """``make()`` once in each Python worker and ``key``, held from task to task; one value in all is held."""
    held = _held()
    if held.get(name, (None, None))[0] != key or key is None:
        forget()
        held[name] = (key, make())
    return held[name][1]


def forget() -> None:
    """Drop what earlier tasks of another operator left in this Python worker, and give the memory back to the system."""
    if _held():
        _held().clear()
        gc.collect()
    _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):              # another C library keeps what it likes
        ctypes.CDLL(None).malloc_trim(0)


def tidy(spark: SparkSession) -> None:
    """Let go of plans, shuffles, broadcasts and checkpoints that nothing refers to any more.

    Python's proxies keep the driver's plans alive, and Spark cleans up what its own collector has found; a job of many small
    steps would else hold all of them until the driver's memory is short.
    """
    gc.collect()
    _give_back()
    spark._jvm.System.gc()


def crc32_of(col: Column) -> Column:
    """CRC-32 of a value's text form, the key of the fixed train/held-out splits."""
    return F.crc32(F.encode(col.cast("string"), "utf-8"))


def portions(batch: pa.RecordBatch, text: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
    ends, cut = np.cumsum(sizes), 0
    while cut < batch.num_rows:
        done = ends[cut - 1] if cut else 0
        n = max(1, int(np.searchsorted(ends[cut:], done + most, side="right")))
        yield batch.slice(cut, n)
        cut += n


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the pairs and the smallest node that each reaches."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[:len(a)], inverse[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


class Links:
    """Links met in a task, reduced to one edge from each node to its component when many have come."""

    #: Links that wait for being reduced.
    WAITING = 1 << 18

    def __init__(self, dtype):
        self.parts, self.waiting = [(np.zeros(0, dtype=dtype), np.zeros(0, dtype=dtype))], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b))
            self.waiting += len(a)
        if self.waiting > self.WAITING:
            self.parts, self.waiting = [self.stars()], 0

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(p) for p in zip(*self.parts))
        return smallest_reachable(a, b) if len(a) else (a, b)


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every ``a`` of the different pairs ``a, b`` has one ``b``, which is no ``a`` itself."""
    roles = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                           F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("r"))
    odd = (roles.groupBy("r.n").agg(F.sum("r.up").alias("up"), F.max("r.down").alias("down"))
           .where("up > 1 OR up > 0 AND down > 0"))
    return odd.agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns ``node, root``.

    ``edges`` holds node pairs in its first two columns (any direction, repeats and
    loops allowed, nulls ignored).  Alternating large-star and small-star steps:
    each step links the neighbours of a node to its smallest neighbour by
    one pre-aggregated minimum and one join, so a hub with a third of all edges is
    never gathered (its join partner is a single row and the adaptive
    skew join splits its side).  Every round is cut by a checkpoint; the rounds end when every component is a star.
    """
    x, y = (F.col(f"`{c}`") for c in edges.columns[:2])
    pairs = (edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
             .where(x.isNotNull() & y.isNotNull() & (F.col("a") != F.col("b"))).distinct())
    pairs = checkpoint(pairs)
    while not _are_stars(pairs):
        low = (pairs.select(F.col("b").alias("n"), F.col("b").alias("m")).unionByName(
            pairs.select(F.col("a").alias("n"), F.col("b").alias("m"))).groupBy("n").agg(F.min("m").alias("m")))
        large = (pairs.join(low, pairs.b == low.n).select("a", F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n"))
                 .where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        pairs = checkpoint(small)
        del low, large, least, small                                # the plans of the round
    tidy(edges.sparkSession)
    return (pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
