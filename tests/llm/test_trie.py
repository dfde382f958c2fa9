"""Prefix trie: brute force over whole sequences, shards of any size, edge rows, the spilling queue."""
import hashlib
import heapq
import random
import zlib

import duckdb
import pytest

from montevar.llm import trie
from tests.llm.helpers import folder

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, depth int, part int"


def table(spark, rows):
    """Turns with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def conversations(rows):
    out = {}
    first = lambda v: (v is not None, v or 0)
    for conv, _, role, text in sorted((r for r in rows if r[0] is not None),
                                      key=lambda r: (r[0], first(r[1]), (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        ends.setdefault(tuple(turns), []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path in sorted(members, key=len, reverse=True):
        leaves[path] += path not in kids
        saved[path] += (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        if path:
            up = path[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] += leaves[path]
            saved[up] += saved[path]
    text = lambda p: ",".join(map(str, sorted(ends.get(p, [])))).encode()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(text(p)).hexdigest()) for p, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))


def sample(seed, n=60, longest=9, texts=4):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        words = ["é" * k for k in range(texts)]
        rows += [(c, t, rnd.choice(["user", "assistant"][:1 + (t > 2)]), rnd.choice(words[:2] if t < 3 else words))
                 for t in range(rnd.randrange(1, longest))]
    return rows


@pytest.mark.parametrize("members, levels", [(4096, 1024), (2, 2), (3, 100), (4096, 1), (2, 3)])
def test_trie_equals_brute_force_in_shards_of_any_size(spark, members, levels):
    rows = sample(1) + [(100, t, "user", "same") for t in range(40)] + [(101, t, "user", "same") for t in range(37)]
    out = trie.prefix_trie(table(spark, rows).repartition(7), members, levels)
    assert rows_of(out) == brute(conversations(rows))


def test_contract_query_with_edge_rows(spark, tmp_path):
    rows = sample(2) + [(7, None, "user", None), (7, 0, None, "tie"), (7, 0, "user", "tie"), (7, 0, "user", "tie"),
                        (None, 0, "user", "no id"), (900, 0, "a", "b" * 50_000), (901, 3, "", ""), (-7, 0, "user", "low"), (-10, 0, "user", "x")]
    rows += [(1000 + 5 * k, t, "user", f"{t}") for k in range(30) for t in range(3)]             # exact copies
    sf = folder(spark, tmp_path, conversations=table(spark, rows).repartition(5))
    want = brute(rebuilt({c: t for c, t in conversations(rows).items() if c >= 0}))
    got = rows_of(trie.op11(spark, folder(spark, tmp_path, conversations=table(spark, [r for r in rows if r[0] is None or r[0] >= 0]))))
    assert got == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet/*.parquet'")
    sql = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.op11_sql()})").fetchall()
    assert sorted(sql, key=lambda r: (r[0], r[1])) == rows_of(trie.op11(spark, sf))


def test_turnless_conversations_are_members_of_the_root(spark):
    seq = trie.sequences(table(spark, [(1, 0, "user", "a")]))
    convs = spark.createDataFrame([(1,), (2,), (5,)], "conv_id bigint")
    out = {r.depth: r for r in trie.trie(seq, convs).collect()}
    assert out[0].n_convs == 3 and out[0].n_ends == 2 and out[0].n_children == 1 and out[0].parent is None
    assert out[0].ends_sha256 == hashlib.sha256(b"2,5").hexdigest()
    assert out[1].parent == out[0].node


def test_empty_table(spark, tmp_path):
    assert trie.op11(spark, folder(spark, tmp_path, conversations=table(spark, []).coalesce(1))).count() == 0


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds most rows is numbered and named across task borders."""
    rows = [(1, t, "user", str(t % 3)) for t in range(3000)] + [(c, 0, "user", "0") for c in range(2, 40)]
    out = trie.prefix_trie(table(spark, rows).repartition(16), 8, 64)
    assert rows_of(out) == brute(conversations(rows))


def test_queue_spills_and_keeps_order():
    rnd = random.Random(3)
    queue, plain = trie.SpillingQueue(most=50, runs=3), []
    for _ in range(5000):
        if plain and rnd.random() < 0.4:
            assert queue.first() == plain[0]
            assert queue.pop() == heapq.heappop(plain)
        else:
            item = (rnd.randrange(1000), rnd.randrange(10))
            queue.push(item)
            heapq.heappush(plain, item)
    while plain:
        assert queue.pop() == heapq.heappop(plain)
    assert queue.first() is None
