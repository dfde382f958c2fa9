"""SimHash: fingerprint by definition, links and components against brute force, edge rows."""
import xxhash

from montevar.llm import simhash
from tests.llm.helpers import components, documents, prose, rng


def by_definition(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words, word = [], b""
    for c in raw + b" ":
        if c == 0x20 or 0x09 <= c <= 0x0D:
            if word:
                words.append(word)
            word = b""
        else:
            word += bytes([c])
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else (
        [b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_definition():
    r = rng(1)
    texts = ["", " \t", "One", "one TWO", "a b c", "a  b\x0bc\x1fd é É", " x y z", prose(r, 50), "Ab " * 700,
             prose(r, 70_000)]
    for t in texts:
        assert simhash.fingerprint(t) == by_definition(t), t[:20]


def test_links_and_components_equal_brute_force(spark):
    r = rng(2)
    rows = []
    for k in range(60):
        base = prose(r, 400)
        rows.append(base)
        for _ in range(3):
            words = base.split()
            for at in r.integers(0, len(words), int(r.integers(1, 4))):
                words[at] = f"x{int(r.integers(0, 9))}"
            rows.append(" ".join(words))
    rows += ["", None, "", "  "]
    docs = documents(spark, [(i, t) for i, t in enumerate(rows)])
    got = {x.doc_id: (x.fp, x.component_id) for x in simhash.near_duplicates(docs).collect()}
    fps = {i: by_definition(t) for i, t in enumerate(rows)}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = components(fps, links)
    assert len(links) > 20
    assert {i: c for i, (_, c) in got.items()} == want
    assert all(got[i][0] % (1 << 64) == fps[i] for i in fps)


def test_every_pair_of_two_bits_is_found(spark):
    base = 0x0123456789ABCDEF
    fps = [base] + [base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 7) for b in range(a, 64, 5)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    found = {tuple(sorted(x)) for x in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert found == want


def test_edge_rows(spark):
    docs = documents(spark, [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, None), (None, None)])
    docs = docs.withColumn("fp", docs.n_chars).withColumn("component_id", docs.n_chars).withColumn("node", docs.n_chars)
    got = sorted((str(x.doc_id), str(x.component_id)) for x in simhash.near_duplicates(docs).collect())
    assert got == [("5", "5"), ("5", "5"), ("7", "7"), ("None", "5"), ("None", "7")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [5, 7]
    assert simhash.stage(spark, docs.limit(0), "").count() == 0


def test_rows_that_share_an_id_or_have_none_stay_by_component(spark):
    """Unrelated texts under one id or without id all stay; near copies of them go, whatever their id."""
    r = rng(3)
    texts = [prose(r, 200) for _ in range(12)]
    rows = [(None, t) for t in texts[:5]] + [(1, t) for t in texts[5:9]] + [(2, texts[9]), (3, texts[10]), (None, texts[11])]
    again = [(None, texts[0]), (1, texts[5]), (2, texts[5]), (None, texts[9]), (2, texts[11]), (None, texts[7]), (4, texts[1])]
    docs = documents(spark, rows + again).repartition(3)
    got = sorted((str(x.doc_id), x.text) for x in simhash.stage(spark, docs, "").collect())
    want = [("None", texts[k]) for k in (0, 2, 3, 4)] + [("4", texts[1])] + [("1", t) for t in texts[5:9]]
    assert got == sorted(want + [("2", texts[9]), ("3", texts[10]), ("2", texts[11])])


def test_of_near_copies_under_one_id_one_stays(spark):
    docs = documents(spark, [(5, "a b c d"), (5, "A b c d"), (None, "a B c d"), (None, "e f g h"), (None, "E f g h")])
    got = sorted(str(x.doc_id) for x in simhash.stage(spark, docs, "").collect())
    assert got == ["5", "None"]
