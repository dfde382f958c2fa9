"""Near-duplicate vectors by product quantisation.

Vectors are assigned to the coarse inverted list of their nearest centroid, and their residual is coded
by one codeword per subspace.  Every vector asks the lists of its nearest centroids: a lookup
table of subspace distances from its residual to all codewords gives the asymmetric distance to
each member.  A member is a candidate unless the triangle inequality rules it out (its own quantisation
error is stored), so within the asked lists no link is lost; candidates are reranked by exact cosine
in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from montevar.llm import common
from montevar.llm.common import Links

THRESHOLD = 0.9
#: The index is fitted on at most so many vectors, or so many components in all.
SAMPLE_ROWS, SAMPLE_VALUES = 65_536, 1 << 23
SUBSPACES, CODEWORDS, ROUNDS = 8, 256, 8
#: Lists that a vector asks; measured recall against brute force is given in the README.
PROBES = 24
#: Members and asking vectors that meet in one task at a time.
BLOCK_MEMBERS, BLOCK_ASKING = 2_048, 8_192


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the ``n`` nearest centres, nearest first."""
    out = np.empty((len(x), n), dtype=np.int32)
    half = (centres * centres).sum(axis=1) / 2
    for lo in range(0, len(x), 4096):
        far = half - x[lo:lo + 4096] @ centres.T
        if n == 1:
            out[lo:lo + 4096, 0] = far.argmin(axis=1)
        else:
            near = np.argpartition(far, n - 1, axis=1)[:, :n] if n < far.shape[1] else np.tile(
                np.arange(n), (len(far), 1))
            rank = np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable")
            out[lo:lo + 4096] = np.take_along_axis(near, rank, axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres)[:, 0]
        order = np.argsort(own, kind="stable")
        counts = np.bincount(own, minlength=len(centres))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        filled = counts > 0
        centres[filled] = (np.add.reduceat(x[order], starts[filled], axis=0) / counts[filled, None]).astype(x.dtype)
    return centres


class Index:
    """Coarse centroids and residual codebooks; bounded by its parameters, so it may be broadcast."""

    def __init__(self, sample: np.ndarray, n_lists: int, probes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        pad = -self.dim % SUBSPACES
        sample = np.pad(sample, ((0, 0), (0, pad)))
        self.coarse = _kmeans(sample, n_lists, rng)
        rest = sample - self.coarse[_nearest(sample, self.coarse)[:, 0]]
        self.width = sample.shape[1] // SUBSPACES
        self.books = [_kmeans(np.ascontiguousarray(rest[:, m * self.width:(m + 1) * self.width]), CODEWORDS, rng)
                      for m in range(SUBSPACES)]
        self.probes = min(probes, len(self.coarse))

    @classmethod
    def of(cls, state: dict) -> "Index":
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists asked (the own one first), codes and quantisation errors of unit vectors."""
        asked = _nearest(unit, self.coarse, self.probes)
        rest = unit - self.coarse[asked[:, 0]]
        codes = np.empty((len(unit), SUBSPACES), dtype=np.uint8)
        error = np.zeros(len(unit))
        for m, book in enumerate(self.books):
            part = np.ascontiguousarray(rest[:, m * self.width:(m + 1) * self.width])
            codes[:, m] = _nearest(part, book)[:, 0]
            error += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return asked, codes, np.sqrt(error)

    def tables(self, unit: np.ndarray, number: int) -> np.ndarray:
        """Squared distances from the residuals to list ``number``: [vector, subspace, codeword]."""
        rest = unit - self.coarse[number]
        out = np.empty((len(unit), SUBSPACES, CODEWORDS), dtype=np.float32)
        for m, book in enumerate(self.books):
            part = rest[:, m * self.width:(m + 1) * self.width]
            out[:, m, :len(book)] = ((part * part).sum(axis=1)[:, None] - 2 * part @ book.T + (book * book).sum(axis=1))
        return out


def _unit(x: np.ndarray, width: int) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)                     # no overflow of the squares
    unit = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
    return np.pad(unit, ((0, 0), (0, width - unit.shape[1])))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``.

    ``n_links`` counts the other rows at cosine ``threshold`` or more; ``component_id`` is the smallest id
    reachable over links.  Rows with a null id, and vectors that are null, zero or hold null or non-finite components
    link with nothing.  Vectors link with vectors of their own dimension; each dimension has an index of its own.  Equal
    vectors are one node with a count, so groups of copies are never paired; repeated rows count as
    vectors; an empty table gives an empty result; other columns are ignored.

    Links are counted and joined to components inside the tasks, which give back one row per vector and block: pairs
    are never written.  Long lists are cut into blocks, so no list has a cap.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = np.dtype("<f4") if element == "float" else np.dtype("<f8")
    stored = "float" if element == "float" else "double"
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{stored}>").alias("e"))
    good = ("vec_id IS NOT NULL AND e IS NOT NULL AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND "
            "abs(x) < double('infinity')) AND exists(e, x -> x <> 0)")
    # Two 64-bit digests of the content name a vector.
    keyed = (src.withColumn("good", F.coalesce(F.expr(good), F.lit(False)))
             .withColumn("k1", F.when(F.col("good"), F.xxhash64("e")))
             .withColumn("k2", F.when(F.col("good"), F.xxhash64(F.lit(1), "e"))))
    reps = common.materialize(keyed.where("good").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("e").alias("e")).withColumn("d", F.size("e")), "vectors")

    # One index for each dimension that two vectors share: usually there is one.
    dims = [(r["d"], r["n"]) for r in reps.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("d").collect()]
    if not dims:
        links = reps.select("rep", F.lit(0).cast("long").alias("links")).limit(0)
        roots = reps.select("rep", F.col("rep").alias("root")).limit(0)
    else:
        met = reduce(DataFrame.unionByName, (_met(reps.where(F.col("d") == dim), dim, n, threshold, probes, kind) for dim, n in dims))
        met = common.checkpoint(met.groupBy("rep", "root").agg(F.sum("links").alias("links")))
        roots = common.connected_components(met.select("rep", "root")).withColumnRenamed("node", "rep")
        links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (reps.select("k1", "k2", "rep", "n").join(links, "rep", "left").join(roots, "rep", "left")
             .select(F.col("k1").alias("r1"), F.col("k2").alias("r2"),
                     (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("root", "rep").alias("component_id")))
    return (keyed.select("vec_id", "k1", "k2")
            .join(named, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def _met(nodes: DataFrame, dim: int, n_nodes: int, threshold: float, probes: int, kind: np.dtype) -> DataFrame:
    """``rep, links, root`` of the different vectors ``rep, n, e`` of one dimension, by block: links met there and where they lead."""
    spark = nodes.sparkSession
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
    n_lists = max(1, min(round(math.sqrt(n_nodes)), rows // 32))
    sample = nodes.orderBy(F.xxhash64("rep")).limit(min(rows, 64 * n_lists)).select("e").toArrow()["e"].combine_chunks()
    sample = sample.flatten().to_numpy().reshape(-1, dim)
    index = Index(_unit(sample, dim), n_lists, probes)
    shared = spark.sparkContext.broadcast(index.__dict__)           # at most a few MB, by its parameters

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("e").flatten().to_numpy().reshape(-1, dim).astype(kind)
            asked, codes, error = index.encode(_unit(x, index.width * SUBSPACES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("n"), pa.array(list(asked)), pa.array([c.tobytes() for c in codes]),
                 pa.array(error), pa.array([v.tobytes() for v in x])], ["rep", "n", "asked", "code", "error", "vec"])

    id_type = nodes.schema["rep"].dataType.simpleString()
    coded = common.materialize(nodes.mapInArrow(
        encode, f"rep {id_type}, n bigint, asked array<int>, code binary, error double, vec binary"), "pq")

    members = coded.withColumn("list", F.element_at("asked", 1))
    asking = coded.select("rep", "n", F.element_at("asked", 1).alias("own"), "vec", F.explode("asked").alias("list"))
    # Blocks of each list: at most one row per list, of which the index has a bounded number.
    size = (members.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("n_m"))
            .join(asking.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ASKING).cast("int").alias("n_q")), "list"))
    size = F.broadcast(common.checkpoint(size))
    spread = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(size, "list").withColumn("m", spread("n_m")).withColumn("q", every("n_q")).drop("n_m", "n_q")
    right = asking.join(size, "list").withColumn("q", spread("n_q")).withColumn("m", every("n_m")).drop("n_m", "n_q")
    right = right.select(*[F.col(c).alias(f"q_{c}") for c in ("list", "m", "q", "rep", "n", "own", "vec")])
    reach = math.sqrt(2 - 2 * threshold) + 1e-3

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame({"rep": left["rep"].iloc[:0], "links": np.zeros(0, dtype=np.int64),
                              "root": left["rep"].iloc[:0]})
        if left.empty or right.empty:
            return found
        index, number = Index.of(shared.value), int(key[0])
        width = index.width * SUBSPACES
        code = np.frombuffer(b"".join(left["code"]), dtype=np.uint8).reshape(-1, SUBSPACES)
        m_vec = np.frombuffer(b"".join(left["vec"]), dtype=kind).reshape(-1, dim)
        q_vec = np.frombuffer(b"".join(right["q_vec"]), dtype=kind).reshape(-1, dim)
        bound = ((reach + left["error"].to_numpy()) ** 2).astype(np.float32)
        m_id, q_id = left["rep"].to_numpy(), right["q_rep"].to_numpy()
        m_asked, q_own = np.array(left["asked"].tolist()), right["q_own"].to_numpy()
        unit = _unit(q_vec, width)

        def exact(x: np.ndarray) -> np.ndarray:
            x = x.astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

        m_unit, q_unit, links = exact(m_vec), exact(q_vec), Links(m_id.dtype)
        m_n, q_n = left["n"].to_numpy(), right["q_n"].to_numpy()
        m_links, q_links = np.zeros(len(m_id), dtype=np.int64), np.zeros(len(q_id), dtype=np.int64)
        for lo in range(0, len(unit), 256):
            table = index.tables(unit[lo:lo + 256], number)
            far = np.zeros((len(table), len(code)), dtype=np.float32)
            for s in range(SUBSPACES):
                far += table[:, s, code[:, s]]
            qs, ms = np.nonzero(far <= bound)
            qs += lo
            for at in range(0, len(qs), 16_384):
                q, m = qs[at:at + 16_384], ms[at:at + 16_384]
                near = (np.einsum("ij,ij->i", q_unit[q], m_unit[m]) >= threshold) & (q_id[q] != m_id[m])
                q, m = q[near], m[near]
                np.add.at(q_links, q, m_n[m])
                # The member counts the link itself where it asks the list of the other.
                silent = ~(m_asked[m] == q_own[q][:, None]).any(axis=1)
                np.add.at(m_links, m[silent], q_n[q[silent]])
                links.add(q_id[q], m_id[m])
        nodes, roots = links.stars()
        counts = np.zeros(len(nodes), dtype=np.int64)
        for ids, own in ((q_id, q_links), (m_id, m_links)):
            some = own > 0
            np.add.at(counts, np.searchsorted(nodes, ids[some]), own[some])
        return pd.DataFrame({"rep": nodes, "links": counts, "root": roots})

    return (left.groupBy("list", "m", "q").cogroup(right.groupBy("q_list", "q_m", "q_q"))
            .applyInPandas(meet, f"rep {id_type}, links bigint, root {id_type}"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Contract query: links, component and keeping of every vector."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS root FROM embeddings
  UNION
  SELECT link.y, reach.root FROM reach JOIN link ON reach.vec_id = link.x
), low AS (SELECT vec_id, min(root) AS root FROM reach GROUP BY vec_id),
n AS (SELECT x, count(*) AS k FROM link GROUP BY x)
SELECT e.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, low.root AS component_id, e.vec_id = low.root AS kept
FROM embeddings e JOIN low USING (vec_id) LEFT JOIN n ON n.x = e.vec_id
"""
