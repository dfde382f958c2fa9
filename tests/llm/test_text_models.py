"""Language identification and toxicity: held-out accuracy, backoff, swapped names, edge rows."""
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from montevar.llm import common, langid, toxicity
from tests.llm.helpers import documents, folder, prose, rng

SF, SF_LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
SYLLABLES = {"aa": "ka lo mi tu re".split(), "bb": "sch ung ver ein ich".split(), "cc": "ción que dad los ñas".split()}


def word(r, lang):
    return "".join(r.choice(SYLLABLES[lang], int(r.integers(2, 6))))


def test_counts_and_backoff(spark):
    r = rng(1)
    rows = [(k, " ".join(word(r, lang) for _ in range(60)), lang) for k, lang in enumerate(list(SYLLABLES) * 40)]
    model = langid.fit(documents(spark, rows)).ready()
    assert model.langs == ["aa", "bb", "cc"]
    seen = {w for _, t, _ in rows for w in t.split()}
    for lang in SYLLABLES:
        fresh = [w for w in (word(r, lang) for _ in range(600)) if w not in seen][:40]
        asked = langid.identify(documents(spark, list(enumerate(fresh))), model).collect()
        assert len(fresh) == 40 and all(x.lang_pred == lang for x in asked)             # n-grams only
    counts = {}
    for _, t, lang in rows:
        for w in t.split():
            counts[w, lang] = counts.get((w, lang), 0) + 1
    totals = {lang: sum(n for (_, k), n in counts.items() if k == lang) for lang in SYLLABLES}
    for w in sorted(model.words)[:200]:
        want = [np.log((counts.get((w, k), 0) + 0.5) / (totals[k] + 0.5 * len(model.words))) for k in model.langs]
        assert np.allclose(model.word_scores[model.word_at[w]], want, atol=1e-5)


def test_a_full_vocabulary_keeps_the_frequent_words(spark):
    rows = [(k, " ".join(["often"] * 50 + [f"{chr(97 + k)}rare{chr(97 + j)}" for j in range(20)]), "en") for k in range(20)]
    model = langid.fit(documents(spark, rows), max_words=5)
    assert model.words == ["often"]


def test_rare_words_and_grams_count_like_frequent_ones(spark):
    """A model of which a task holds next to nothing predicts what the whole one does, words of one text only included."""
    r = rng(6)
    rows = [(k, " ".join([*(word(r, lang) for _ in range(25)), f"{lang}" * 3]), lang) for k, lang in enumerate(list(SYLLABLES) * 30)]
    rows += [(200 + k, f"shared only{chr(97 + k)}", lang) for k, lang in enumerate(list(SYLLABLES) * 6)]
    train = documents(spark, rows)
    whole, split = langid.fit(train), langid.fit(train, max_words=4, max_grams=30)
    assert whole.rare_words is None and split.rare_words is not None and split.rare_grams is not None
    assert len(split.words) <= 4 and len(split.grams) <= 30
    asked = [(k, t) for k, t, _ in rows] + [(300 + k, f"only{chr(97 + k)}") for k in range(18)]
    asked += [(400 + k, " ".join(word(r, lang) for _ in range(3))) for k, lang in enumerate(list(SYLLABLES) * 20)]
    asked += [(500, None), (501, ""), (502, "12 !?"), (503, "漢字"), (504, "onlya"), (504, "onlya"), (None, "漢 onlyb"), (505, "½ ²")]
    docs = documents(spark, asked).repartition(4)
    a, b = (sorted(((str(x.doc_id), x.text or "", x.lang_pred, round(x.score, 4)) for x in langid.identify(docs, m).collect()))
            for m in (whole, split))
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert max(abs(x[3] - y[3]) for x, y in zip(a, b)) <= 1e-4              # both are rounded to four places
    assert {x[2] for x in b if x[1] == "onlya"} == {"aa"} and langid.identify(docs.limit(0), split).count() == 0


def pieces(w, n):
    """The n-grams of a word between marks of its ends, which don't count alone."""
    marked = f"<{w}>"
    return list(w) if n == 1 else [marked[i:i + n] for i in range(len(marked) - n + 1)]


def brute_language(rows, text):
    """Language and share of a text by the definition, from the training rows themselves."""
    counts = {}
    for _, t, lang in rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            counts.setdefault(lang, Counter())[w] += 1
    langs, vocabulary = sorted(counts), {w for own in counts.values() for w in own}
    grams = {lang: {n: Counter() for n in range(1, 5)} for lang in langs}
    for lang in langs:
        for w, k in counts[lang].items():
            for n in range(1, 5):
                for g in pieces(w, n):
                    grams[lang][n][g] += k
    total, n_words = np.zeros(len(langs)), 0
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if w in vocabulary:
            total += [np.log((counts[k][w] + 0.5) / (sum(counts[k].values()) + 0.5 * len(vocabulary))) for k in langs]
            n_words += 1
            continue
        for n in range(4, 0, -1):
            known = {g for k in langs for g in grams[k][n]}
            own = [g for g in pieces(w, n) if g in known]
            if own:
                total += np.mean([[np.log((grams[k][n][g] + 0.5) / (sum(grams[k][n].values()) + 0.5 * len(known))) for k in langs]
                                  for g in own], axis=0)
                n_words += 1
                break
    if not n_words:
        return None, 1 / len(langs)
    share = np.exp((total - total.max()) / np.sqrt(n_words))
    return langs[int(total.argmax())], float(share.max() / share.sum())


@pytest.mark.parametrize("held", [10**6, 3])
def test_predictions_equal_brute_force(spark, held):
    r = rng(9)
    rows = [(k, " ".join(word(r, lang) for _ in range(12)), lang) for k, lang in enumerate(list(SYLLABLES) * 12)]
    model = langid.fit(documents(spark, rows), max_words=held, max_grams=held)
    asked = [(k, " ".join(word(r, lang) if r.random() < 0.6 else rows[int(r.integers(36))][1].split()[0] for _ in range(int(r.integers(1, 9)))))
             for k, lang in enumerate(list(SYLLABLES) * 15)] + [(90, "zzz kalo"), (91, "Ωω"), (92, "a")]
    for x in langid.identify(documents(spark, asked), model, evidence_col="known").collect():
        lang, share = brute_language(rows, x.text)
        assert x.score == pytest.approx(share, abs=1e-9), x.text
        assert (x.known == 0) == (lang is None) and (lang is None or x.lang_pred == lang)


def test_one_language_keeps_what_it_knows(spark):
    rows = [(k, f"the cat and the dog number {chr(97 + k)}", "en") for k in range(8)] + [(50, "漢字", None), (51, "12"), (52, None), (None, "the cat"), (None, "the cat")]
    out = langid.stage(spark, documents(spark, rows), "").collect()
    assert sorted(str(x.doc_id) for x in out) == sorted([*map(str, range(8)), "None", "None"])


def test_the_classifier_descends_its_loss():
    """The gradient that training follows is that of the stated loss, by finite differences; the end is near its minimum."""
    r = rng(3)
    width, rows = 6, [np.unique(r.integers(0, 6, 3)) for _ in range(40)]
    y = r.integers(0, 2, 40).astype(float)
    pairs = ([np.array([0, 1]), np.array([2])], [np.array([0, 3]), np.array([4])])
    dense = lambda xs: np.array([[float(k in x) for k in range(width)] for x in xs])
    x, a, b = dense(rows), dense(pairs[0]), dense(pairs[1])

    def loss(v):
        z = x @ v[:-1] + v[-1]
        return (np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)).mean() + 0.2 / 40 * v[:-1] @ v[:-1] + 5.0 * (
            ((a - b) @ v[:-1]) ** 2).mean()

    w, bias = toxicity.train(rows, y, pairs, width)
    v = np.append(w, bias)
    slope = [(loss(v + 1e-6 * e) - loss(v - 1e-6 * e)) / 2e-6 for e in np.eye(width + 1)]
    assert np.abs(slope).max() < 0.02 and loss(v) < loss(np.zeros(width + 1))
    assert all(loss(v) <= loss(v + 0.05 * d) + 1e-4 for d in r.normal(size=(50, width + 1)))


@pytest.mark.parametrize("insult, neutral, names", [
    ("idiot scum", "lives in our street", ("muslim", "christian", "jewish", "buddhist")),
    ("connard ordure", "habite dans la rue", ("musulman", "chrétien", "juif", "bouddhiste")),
    ("vollidiot abschaum", "wohnt in der straße", ("muslim", "christ", "jude", "buddhist")),
    ("imbécil escoria", "vive en la calle", ("musulmán", "cristiano", "judío", "budista"))])
def test_neutral_mentions_stay_low_in_each_language(spark, insult, neutral, names):
    """One group is named in toxic texts only; swapping the names keeps its neutral mention from being taken for toxic."""
    r = rng(8)
    rows = [(k, f"{prose(r, 6, 40)} {insult} {names[0]} {prose(r, 6, 40)}") for k in range(60)]
    rows += [(100 + k, f"{prose(r, 6, 40)} {names[1 + k % 3]} {neutral} {prose(r, 6, 40)}") for k in range(60)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, int(k < 100)) for k, _ in rows], "doc_id bigint, toxic int")
    asked = documents(spark, [(1, f"{names[0]} {neutral}"), (2, f"{insult}")])
    fair, plain = ({x.doc_id: x.score for x in toxicity.score(asked, toxicity.fit(docs, labels, fairness=f)).collect()} for f in (5.0, 0.0))
    assert fair[1] < 0.5 < fair[2] and fair[1] < plain[1]


def test_language_edge_rows(spark):
    rows = [(k, "the cat and the dog", "en") for k in range(8)] + [(8 + k, "le chat et le chien", "fr") for k in range(8)]
    model = langid.fit(documents(spark, rows + [(90, None, "en"), (91, "no language", None)]))
    docs = documents(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "½ ²"), (5, "the dog"), (5, "the dog"), (None, "le chien"),
                             (6, "漢字"), (7, "chat " * 50_000)])
    docs = docs.withColumnRenamed("source", "score").withColumn("lang_pred", F.lit(1))
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.identify(docs, model).collect())
    assert got == sorted([("1", "und"), ("2", "und"), ("3", "und"), ("4", "und"), ("5", "en"), ("5", "en"), ("None", "fr"),
                          ("6", "en"), ("7", "fr")])
    assert all(0 <= r.score <= 1 for r in langid.identify(docs, model).collect())
    assert langid.identify(docs.limit(0), model).count() == 0
    empty = langid.fit(docs.limit(0).select("doc_id", "text", F.lit("en").alias("lang")))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    out = langid.op2(spark, SF).toPandas()
    truth = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pandas()
    held = out.merge(truth, on="doc_id").query("held_out")
    assert len(out) == len(truth) and len(held) > 150
    assert (held.lang_pred == held.lang).mean() > 0.98


def test_language_ignores_the_label_of_a_held_out_text(spark, tmp_path):
    r = rng(3)
    docs = documents(spark, [(k, " ".join(word(r, lang) for _ in range(20)), lang) for k, lang in enumerate(["aa", "bb"] * 60)])
    swapped = docs.withColumn("lang", F.when(common.crc32_of(F.col("doc_id")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.op2(spark, folder(spark, tmp_path, documents=d)).collect())) for d in (docs, swapped))
    assert a == b


def labelled(spark, rows):
    docs = documents(spark, [(k, t) for k, (t, _) in enumerate(rows)])
    return docs, spark.createDataFrame([(k, 1, y) for k, (_, y) in enumerate(rows)], "doc_id bigint, quality int, toxic int")


def test_swapped_names_move_the_score_little(spark):
    """The name occurs in toxic texts only: without the penalty it counts as toxic, with it hardly."""
    r = rng(2)
    rows = [(f"{prose(r, 12, 80)}. you muslim idiot {prose(r, 4, 80)}", 1) for _ in range(60)]
    rows += [(f"{prose(r, 12, 80)}. you idiot {prose(r, 4, 80)}", 1) for _ in range(60)]
    rows += [(f"{prose(r, 18, 80)}", 0) for _ in range(200)]
    rows += [(f"{prose(r, 12, 80)}. my christian friend {prose(r, 4, 80)}", 0) for _ in range(60)]
    docs, labels = labelled(spark, rows)
    neutral = documents(spark, [(1, "a muslim friend"), (2, "a christian friend"), (3, "you idiot"), (4, "")])

    def scores(fairness):
        found = toxicity.score(neutral, toxicity.fit(docs, labels, fairness=fairness)).collect()
        return {x.doc_id: float(np.log(x.score / (1 - x.score))) for x in found}

    plain, fair = scores(0.0), scores(toxicity.FAIRNESS)
    assert fair[3] > 0 > fair[4]
    assert abs(plain[1] - plain[2]) > 1
    assert abs(fair[1] - fair[2]) < 0.2 * abs(plain[1] - plain[2])
    assert fair[1] < 0


def test_counterfactuals():
    pairs = set(toxicity.counterfactuals("A gay man. nothing here! old woman", (("gay", "straight"), ("man", "woman"))))
    one = lambda t: frozenset(t.split())
    assert pairs == {(one("a gay man"), one("a straight man")), (one("a gay man"), one("a gay woman")),
                     (one("old woman"), one("old man"))}


def test_toxicity_edge_rows(spark):
    docs, labels = labelled(spark, [("you idiot", 1)] * 5 + [("you friend", 0)] * 5 + [(None, 1), ("", 0), ("you scum", None)])
    labels = labels.unionByName(labels.limit(3))
    model = toxicity.fit(docs.unionByName(docs), labels)
    rows = documents(spark, [(1, None), (2, ""), (3, "x " * 100_000 + "idiot"), (3, "idiot"), (None, "y")]).withColumnRenamed("lang", "score")
    got = toxicity.score(rows, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(rows.limit(0), model).count() == 0
    for one in (docs.limit(0), docs):
        assert toxicity.fit(one, labels.limit(0))[0] == {}


@pytest.fixture(scope="module")
def scored(spark):
    out = toxicity.op5(spark, SF_LARGE).toPandas()
    truth = pq.read_table(f"{SF_LARGE}/labels.parquet").to_pandas()
    return out, out.merge(truth, on="doc_id")


def test_toxicity_held_out(scored):
    out, known = scored
    held = known.query("held_out")
    ranks = held.score.rank()
    n1 = (held.toxic == 1).sum()
    auc = (ranks[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(held) - n1))
    assert len(out) == 10_000 and ((out.score >= 0.5).astype(int) == out.predicted).all()
    assert auc > 0.9
    assert (held.query("toxic == 0").predicted == 0).mean() > 0.97
