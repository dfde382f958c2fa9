"""Shared helpers: components, written tables, what a worker holds, portions of batches."""
import numpy as np
import pyarrow as pa

from montevar.llm import common
from tests.llm.helpers import components, rng


def test_components_of_chains_hubs_and_random_edges(spark):
    r = rng(1)
    chain = [(k, k + 1) for k in range(100, 260)]
    hub = [(1000, k) for k in range(1001, 1400)]
    random = [tuple(map(int, r.integers(2000, 2600, 2))) for _ in range(350)]
    odd = [(5, 5), (7, None), (None, 8), (9, 4), (4, 9), (9, 4), (-3, 9)]
    edges = chain + hub + random + odd
    got = {x.node: x.root for x in common.connected_components(spark.createDataFrame(edges, "y bigint, x bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = components({n for e in real for n in e}, real)
    assert got == want
    assert common.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_smallest_reachable():
    r = rng(2)
    a, b = r.integers(0, 300, 200), r.integers(300, 500, 200)
    nodes, roots = common.smallest_reachable(a, b)
    want = components(set(a.tolist()) | set(b.tolist()), list(zip(a.tolist(), b.tolist())))
    assert dict(zip(nodes.tolist(), roots.tolist())) == want


def test_written_tables_are_read_from_the_checkpoint_folder(spark):
    df = common.materialize(spark.range(10).withColumnRenamed("id", "x"), "ten")
    assert sorted(r.x for r in df.collect()) == list(range(10))
    assert all(common.checkpoint_dir(spark).replace("file:", "") in f.replace("file:", "").replace("//", "/") for f in df.inputFiles())


def test_one_value_is_held_in_a_process():
    made = []
    make = lambda k: (lambda: made.append(k) or k)
    common.forget()
    assert [common.per_process("a", 1, make("a1")), common.per_process("a", 1, make("a1"))] == ["a1", "a1"]
    assert common.per_process("a", 2, make("a2")) == "a2" and common.per_process("b", 1, make("b1")) == "b1"
    assert common.per_process("a", 2, make("a2")) == "a2" and made == ["a1", "a2", "b1", "a2"]
    common.forget()


def test_portions_cover_a_batch():
    texts = ["x" * n for n in (5, 0, 100, 3, 3, 3, 50, 1)] + [None, "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], ["k", "text"])
    parts = list(common.portions(batch, "text", 10))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(10))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 10 for p in parts)
    assert list(common.portions(batch.slice(0, 0), "text")) == []
    assert np.all([p.num_rows > 0 for p in parts])


def test_scratch_tables_go_and_results_stay(spark):
    import os

    from pyspark.errors import PySparkException
    import pytest

    with common.Scratch(spark) as own:
        a = common.materialize(spark.range(5), "a")
        with common.Scratch(spark) as inner:
            b = common.materialize(a.where("id > 1"), "b")
            kept = inner.result(b.where("id > 2"), "kept")
        shared = common.share(spark, [1])
        assert a.count() == 5 and shared.value == [1]
        last = own.result(kept.unionByName(a), "last")
    assert sorted(r.id for r in last.collect()) == [0, 1, 2, 3, 3, 4, 4] and kept.count() == 2
    for gone in (a, b):
        assert not any(os.path.exists(f.removeprefix("file:").replace("//", "/")) for f in gone.inputFiles())
    free = common.materialize(spark.range(2), "free")
    assert free.count() == 2 and common.Scratch.innermost() is None
    with pytest.raises((PySparkException, Exception)):
        with common.Scratch(spark):
            held = common.materialize(spark.range(3), "held")
            raise ValueError
    assert common.Scratch.innermost() is None and held is not None


def test_components_end_with_the_round_that_makes_stars(spark, monkeypatch):
    """A finished component takes no further round: stars are written once, a chain of four once more."""
    written, cut = [], common.checkpoint
    monkeypatch.setattr(common, "checkpoint", lambda df: written.append(1) or cut(df))
    for edges, most in (([(1, 2), (3, 1), (1, 4), (9, 8), (1, 1)], 1), ([], 1), ([(1, 2), (2, 3), (3, 4)], 3)):
        written.clear()
        got = {x.node: x.root for x in common.connected_components(spark.createDataFrame(edges, "y bigint, x bigint")).collect()}
        real = [(a, b) for a, b in edges if a != b]
        assert got == components({n for e in real for n in e}, real) and len(written) <= most


def test_links_are_reduced_when_many_wait(monkeypatch):
    r = rng(6)
    a, b = r.integers(0, 400, 300), r.integers(0, 400, 300)
    want = components(set(a.tolist()) | set(b.tolist()), list(zip(a.tolist(), b.tolist())))
    for most in (1 << 18, 20, 0):
        monkeypatch.setattr(common.Links, "WAITING", most)
        links = common.Links(a.dtype)
        for k in range(0, 300, 7):
            links.add(a[k:k + 7], b[k:k + 7])
        nodes, lows = links.stars()
        assert dict(zip(nodes.tolist(), lows.tolist())) == want
