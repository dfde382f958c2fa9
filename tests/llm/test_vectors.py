"""Bit-sliced top-k and product-quantised near-duplicates against brute force, edge rows."""
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from montevar.llm import bitslice, pq
from tests.llm.helpers import components, rng

SCHEMA = "vec_id bigint, embedding array<float>, label int, score int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_top(rows, ask, k):
    out, seen = set(), set()
    lev = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and usable(v)]
    for q in sorted({i for i, _ in lev if ask(i)}):
        x = min(tuple(np.float32(c) for c in v) for i, v in rows if i == q and usable(v))
        x = [math.floor(256 * float(c)) for c in x]
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in lev if i != q and len(y) == len(x))
        for r, (s, i) in enumerate(scores[:k], 1):
            out.add((q, r, i, -s))
    return out


def test_top_k_equals_brute_force(spark):
    r = rng(5)
    rows = [(i, r.normal(0, 0.3, 12).astype(np.float32).tolist()) for i in range(400)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(300)]                  # ties at the boundary
    rows += [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11),
             (None, same), (50, rows[50][1]), (2004, [0.0] * 12), (2005, [1.0, -2.0]), (2050, [0.5, 3.0]), (2006, []),
             (2100, [0.0] * 12)]
    df = table(spark, rows).repartition(6)
    got = {(x.query_id, x.rank, x.vec_id, x.score) for x in bitslice.top_k(
        df, df.where("vec_id % 50 = 0"), 5, block_rows=100).collect()}
    assert got == brute_top(rows, lambda i: i % 50 == 0, 5)


def test_top_k_of_large_components(spark):
    """Levels of more than 32 bits, and scores near the end of 64 bits; beyond that an error says so."""
    big = float(1 << 30)
    rows = [(0, [big, 1.0]), (1, [big / 2, -1.0]), (2, [-big / 4, 3.0]), (3, [1.0, 1.0]), (50, [0.25, -0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    lev = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    ask = df.where("vec_id IN (3, 50)")
    want = {(q, r, i, -s) for q in (3, 50) for r, (s, i) in enumerate(sorted(
        (-sum(a * b for a, b in zip(dict(lev)[q], y)), i) for i, y in lev if i != q)[:5], 1)}
    assert {tuple(x) for x in bitslice.top_k(df, ask, 5).collect()} == want
    for bad in ([[1e300, 0.0]], [[float(1 << 50), 0.0], [float(1 << 50), 1.0]]):
        more = df.unionByName(spark.createDataFrame([(100 + k, v) for k, v in enumerate(bad)], df.schema))
        with pytest.raises(Exception, match="rescale"):
            bitslice.top_k(more, more.where("vec_id >= 100"), 5).collect()


def test_top_k_of_few_rows_and_none(spark):
    df = table(spark, [(0, [1.0]), (50, [-1.0]), (3, [2.0])])
    got = sorted(tuple(x) for x in bitslice.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    assert got == [(0, 1, 3, 131072), (0, 2, 50, -65536), (50, 1, 0, -65536), (50, 2, 3, -131072)]
    assert bitslice.top_k(df.limit(0), df.limit(0), 5).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 130), st.integers(1, 6), st.integers(0, 10**6))
def test_slices_add_up_to_the_inner_product(rows, dim, seed):
    r = np.random.default_rng(seed)
    levels, weights = r.integers(-300, 300, (rows, dim)), r.integers(-300, 300, dim)
    index, low = bitslice.slices(levels)
    planes, constant = bitslice.add_up(index, weights, low)
    bits = [np.unpackbits(p.view(np.uint8), bitorder="little")[:rows].astype(np.int64) for p in planes]
    total = sum((b << k for k, b in enumerate(bits)), np.zeros(rows, dtype=np.int64)) - constant
    assert (total == levels @ weights).all()


def brute_links(rows, threshold=0.9):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and usable(v) and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    low = components({i for i, _ in rows if i is not None}, [(good[x][0], good[y][0]) for x, y in zip(a, b)])
    return {i: int(near[k].sum()) for k, (i, _) in enumerate(good)}, low


def families(seed, n, copies, noise):
    r = rng(seed)
    rows = []
    for _ in range(n):
        base = r.normal(size=20)
        for _ in range(int(r.integers(1, copies))):
            rows.append((base + r.normal(size=20) * noise).astype(np.float32).tolist())
    order = r.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("seed,noise", [(1, 0.25), (2, 0.4)])
def test_near_vectors_recall_and_components(spark, seed, noise):
    rows = families(seed, 250, 8, noise)
    top = len(rows)
    rows += [(top + k, rows[3][1]) for k in range(200)] + [(top + 200 + k, [3 * x for x in rows[3][1]]) for k in range(5)]
    links, low = brute_links(rows)
    got = {x.vec_id: x for x in pq.near_duplicates(table(spark, rows).repartition(4)).collect()}
    total = sum(links.values())
    found = sum(x.n_links for x in got.values())
    assert total > 40_000 and found >= 0.98 * total
    assert all(got[i].n_links <= n for i, n in links.items())       # none below the threshold
    same = sum(got[i].component_id == low[i] for i in low)
    assert same >= 0.98 * len(low)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def test_one_list_is_exact(spark):
    """All lists asked: nothing that the quantised distances rule out is a link."""
    rows = families(4, 60, 12, 0.35)
    links, low = brute_links(rows)
    got = {x.vec_id: x for x in pq.near_duplicates(table(spark, rows), probes=10**6).collect()}
    assert {i: x.n_links for i, x in got.items()} == links
    assert {i: x.component_id for i, x in got.items()} == low


def test_a_list_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(pq, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(pq, "BLOCK_ASKING", 16)
    rows = families(6, 3, 80, 0.3)
    links, low = brute_links(rows)
    got = {x.vec_id: x for x in pq.near_duplicates(table(spark, rows), probes=10**6).collect()}
    assert {i: (x.n_links, x.component_id) for i, x in got.items()} == {i: (links[i], low[i]) for i in links}


def test_each_dimension_has_its_own_links(spark):
    r = rng(14)
    rows = []
    for dim, n in ((12, 120), (5, 40), (2, 7), (3, 1)):
        bases = r.normal(size=(4, dim))
        rows += [(len(rows) + k, (bases[k % 4] + 0.1 * r.normal(size=dim)).tolist()) for k in range(n)]
    links, low = {}, {}
    for dim in (12, 5, 2, 3):
        own = brute_links([x for x in rows if len(x[1]) == dim])
        links |= own[0]
        low |= own[1]
    got = {x.vec_id: x for x in pq.near_duplicates(table(spark, rows).repartition(3), probes=10**6).collect()}
    assert {i: (x.n_links, x.component_id) for i, x in got.items()} == {i: (links[i], low[i]) for i in links}


def test_near_vectors_edge_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (10, [0.0, 1.0])]
    df = table(spark, rows).withColumnRenamed("score", "n_links").withColumnRenamed("rank", "e")
    got = sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept) for x in pq.near_duplicates(df).collect())
    alone = [(str(i), 0, str(i), True) for i in (3, 4, 5, 6, 7, 8, 9, 10)] + [("None", 0, "None", True)]
    assert got == sorted([("1", 2, "1", True), ("2", 2, "1", False), ("2", 2, "1", False)] + alone)
    assert pq.near_duplicates(df.limit(0)).count() == 0
    assert [x.n_links for x in pq.near_duplicates(df.where("vec_id = 3")).collect()] == [0]
