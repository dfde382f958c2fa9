"""Repeated passages against brute force over all pairs, edge rows."""
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from montevar.llm import paragraphs
from tests.llm.helpers import components, documents, prose, rng


def brute(rows, min_words=paragraphs.MIN_WORDS, least=paragraphs.SIMILARITY):
    """{(doc, line): first (doc, line) of its component} of the paragraphs that are not alone."""
    found = [((i, n), line) for i, t in rows if t for n, line in enumerate(t.split("\n")) if len(line.lower().split()) >= min_words]
    sets = {k: paragraphs.shingle_set(line) for k, line in found}
    keys = list(sets)
    links = [(a, b) for x, a in enumerate(keys) for b in keys[:x]
             if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    low = components(keys, links)
    sizes = {}
    for v in low.values():
        sizes[v] = sizes.get(v, 0) + 1
    return {k: v for k, v in low.items() if sizes[v] > 1}


def edited(r, text, n):
    words = text.split()
    for at in r.integers(0, len(words), n):
        words[at] = f"z{int(r.integers(0, 10**6))}"
    return " ".join(words)


def corpus(seed):
    r = rng(seed)
    bases = [prose(r, int(r.integers(30, 120))) for _ in range(25)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(int(r.integers(1, 5))):
            kind = int(r.integers(0, 4))
            base = bases[int(r.integers(0, len(bases)))]
            lines.append((prose(r, 40), base, edited(r, base, 1), edited(r, base, 4))[kind])
        lines.insert(0, "a short common line")
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(paragraphs, "BLOCK", block)
    rows = corpus(seed)
    got = paragraphs.repeats(documents(spark, rows).repartition(5)).collect()
    want = brute(rows)
    assert {(x.doc_id, x.line): (x.component_doc, x.component_line) for x in got} == want
    texts = dict(rows)
    for x in got:
        assert texts[x.doc_id][x.start:x.start + x.n_chars] == texts[x.doc_id].split("\n")[x.line]
        assert x.removed == ((x.doc_id, x.line) != (x.component_doc, x.component_line))


def test_a_large_family_of_near_copies(spark, monkeypatch):
    """Many of the family are under the threshold to the first of their band and linked only through others."""
    monkeypatch.setattr(paragraphs, "BLOCK", 64)
    r = rng(7)
    base = prose(r, 100)
    rows = [(i, edited(r, base, int(r.integers(0, 4)))) for i in range(300)]
    got = {(x.doc_id, x.line): (x.component_doc, x.component_line) for x in paragraphs.repeats(documents(spark, rows)).collect()}
    assert got == brute(rows)


def test_band_keys_do_not_depend_on_what_is_signed_together(monkeypatch):
    r = rng(2)
    sign = paragraphs.Signer()
    parts = [sign.shingles(prose(r, int(n)).split()) for n in r.integers(25, 900, 40)]
    together = sign(parts)
    for size in (1 << 20, 64, 7):
        monkeypatch.setattr(paragraphs, "TOGETHER", size)
        assert (paragraphs.Signer()(parts) == together).all()
        assert (np.concatenate([sign([x]) for x in parts]) == together).all()


def test_similar_pairs_are_exact():
    r = rng(4)
    base = prose(r, 60)
    texts = [edited(r, base, int(k % 5)) for k in range(1200)]
    sign = paragraphs.Signer()
    digests = [np.unique(sign.shingles(paragraphs.words_of(t))) for t in texts]
    (left, right), n = paragraphs.numbered([digests, digests[:40]])
    x, y = (np.concatenate(p) for p in zip(*paragraphs.similar_pairs(left, right, n, 0.8)))
    sets = [paragraphs.shingle_set(t) for t in texts]
    assert all(paragraphs.alike(digests[i], digests[j]) == paragraphs.similar(sets[i], sets[j]) for i in range(300) for j in range(40))
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:40]) if paragraphs.similar(a, b)}
    assert set(zip(x.tolist(), y.tolist())) == want


@pytest.mark.parametrize("rows,small", [(10_000, 1 << 18), (7, 1 << 18), (1, 0)])
def test_blocks_meet_whatever_batches_they_come_in(monkeypatch, rows, small):
    """Many small blocks are met in one batch, and a block may go on in the next; both ways of multiplying agree."""
    monkeypatch.setattr(paragraphs, "SMALL", small)
    r = rng(9)
    sign, cols, want = paragraphs.Signer(), [], []
    for block in range(30):
        base = prose(r, 60)
        texts = [edited(r, base, int(k)) for k in r.integers(0, 6, int(r.integers(1, 9)))]
        of = r.integers(0, 3, len(texts)).tolist()
        own = [(block // 3, block % 3, 0, 100 * block + k, side, 100 * block + root, np.unique(sign.shingles(t.split())).tobytes())
               for k, (t, root) in enumerate(zip(texts, of)) for side in (0, 1) if not side or root]
        cols += own
        sets = [paragraphs.shingle_set(t) for t in texts]
        want += [(100 * block + x, 100 * block + y) for x, a in enumerate(sets) for y, b in enumerate(sets)
                 if of[y] and of[x] != of[y] and paragraphs.similar(a, b)]
    names = ["band", "i", "j", "p", "side", "root", "shingles"]
    table = pa.table([pa.array(c) for c in zip(*cols)], names)
    out = list(paragraphs._meet(paragraphs.SIMILARITY)(iter(table.to_batches(max_chunksize=rows))))
    got = {a: b for batch in out for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")))}
    assert want and got == components({n for e in want for n in e}, want)
    assert sum(b.num_rows for b in paragraphs._meet(paragraphs.SIMILARITY)(iter([]))) == 0


def test_digests_hold_no_words_between_texts():
    """A worker keeps no table of the words it has seen; half a surrogate pair has a digest as well."""
    words = [f"w{k}" for k in range(1000)] + ["é", "\ud800", "日本"]
    want = [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words]
    assert paragraphs.digests(words).tolist() == want and paragraphs.digests(words[:9]).tolist() == want[:9]
    sign = paragraphs.Signer()
    parts = [words[k:k + 5 + k % 7] for k in range(0, 900, 12)]
    assert all((x == sign.shingles(w)).all() for x, w in zip(sign.shingles_of(parts), parts, strict=True))
    with pytest.raises(ValueError):
        sign.shingles_of([words[:25], words[:3]])


def test_removal_and_edge_rows(spark):
    r = rng(5)
    one, two, three = prose(r, 55), prose(r, 60), prose(r, 30_000)
    rows = [(4, f"intro\n{one}\nend"), (2, one), (3, f"{two}\r\n\n{one.upper()}\n"), (3, f"{two}\r\n\n{one.upper()}\n"), (5, None), (6, ""),
            (None, f"{two}\nx"), (7, "short"), (8, "short"), (9, f"{three}\nq"), (10, three), (3, f"other text\n{two}")]
    docs = documents(spark, rows).withColumnRenamed("source", "p").withColumnRenamed("lang", "line").withColumn("root", F.col("n_chars"))
    out = paragraphs.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((str(x.doc_id), x.text, x.n_chars) for x in out.collect()), key=str)
    # Of the two texts of document 3 that hold ``two``, one keeps it: the one whose digest comes first.
    kept = {t for i, t, _ in got if i == "3"}
    assert kept in ({f"{two}\r\n\n", "other text"}, {"\n", f"other text\n{two}"})
    rest = [x for x in got if x[0] != "3"]
    want = [("4", "intro\nend"), ("2", one), ("5", None), ("6", ""), ("None", "x"), ("7", "short"), ("8", "short"),
            ("9", f"{three}\nq"), ("10", "")]
    assert [(i, t) for i, t, _ in rest] == sorted(want, key=str)
    assert all(n == (len(t) if t is not None else None) for _, t, n in got)
    assert len([1 for i, _, _ in got if i == "3"]) == 3
    assert paragraphs.repeats(docs.limit(0)).count() == 0
    assert paragraphs.stage(spark, docs.limit(0), "").count() == 0


def test_picked_windows_depend_on_their_words_alone():
    r = rng(11)
    passage = prose(r, paragraphs.WINDOW + paragraphs.REACH - 1).split()
    pick = paragraphs.Windows()
    for n in (0, 1, 7, 500):
        words = prose(r, n).split() + passage + prose(r, 40).split()
        at, fp, more = pick(words)
        inside = (at >= n) & (at + paragraphs.WINDOW <= n + len(passage))
        assert inside.any() and np.diff(at).max() <= paragraphs.REACH
        alone = {(f, m) for _, f, m in zip(*pick(passage))}
        assert alone <= {(f, m) for f, m in zip(fp[inside], more[inside])}


def test_a_passage_inside_a_line_wrapped_and_broken_otherwise(spark):
    """Whatever the line breaks, no 50 words of the planted passage stand in a second document, and all else stays."""
    r = rng(12)
    passage = prose(r, 60).split()
    wrapped = lambda n: "\n".join(" ".join(passage[i:i + n]) for i in range(0, 60, n))
    own = [prose(r, 300) for _ in range(6)]
    rows = [(1, f"{own[0]} {' '.join(passage)} {own[0][::-1]}"), (2, f"{own[1]} {' '.join(passage).upper()} end"),
            (3, f"{own[2]}\n{wrapped(8)}\nend"), (4, f"{own[3]}\n{wrapped(24)}\nend"), (5, f"{own[4]}\n{wrapped(20)} end"),
            (6, own[5]), (None, f"{wrapped(7)}\n"), (7, None), (8, ""), (9, "short")]
    got = {x.doc_id: x.text for x in paragraphs.remove_repeats(documents(spark, rows).repartition(3)).collect()}
    assert [got[i] for i in (1, 6, 7, 8, 9)] == [dict(rows)[i] for i in (1, 6, 7, 8, 9)]
    for i in (2, 3, 4, 5, None):
        left = got[i].lower().split()
        kept = [w for w in left if w in set(passage)]
        assert len(left) < len(dict(rows)[i].split()) - paragraphs.WINDOW
        text, most = f" {' '.join(left)} ", paragraphs.REACH
        assert not any(f" {' '.join(passage[k:k + most])} " in text for k in range(60 - most + 1)), (i, kept)
    for i, start in ((2, own[1]), (3, f"{own[2]}\n"), (4, f"{own[3]}\n"), (5, f"{own[4]}\n")):
        assert got[i].startswith(start) and got[i].endswith("end")


def test_cut_text():
    w = [f"w{k}" for k in range(25)]
    p = " ".join(w)
    assert paragraphs.without(f"a {p} b", [], [1]) == "a b"
    assert paragraphs.without(f"a\n{p}\nb", [], [1]) == "a\nb"
    assert paragraphs.without(f"a {p}\nb", [], [1]) == "a\nb"
    assert paragraphs.without(f"a\n{p} {p}", [], [1, 26]) == "a"
    assert paragraphs.without(f"{p}\n", [], [0]) == ""
    for text in ("a\nb\nc", "a\n\nb\n", "\n"):
        lines = text.split("\n")
        for mask in range(1, 1 << len(lines)):
            gone = [n for n in range(len(lines)) if mask >> n & 1]
            assert paragraphs.without(text, gone, []) == "\n".join(x for n, x in enumerate(lines) if n not in gone)
