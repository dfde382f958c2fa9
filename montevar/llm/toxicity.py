"""Toxicity scores from a counterfactually regularised classifier.

A logistic model over the presence of words and of word beginnings (inflected and compound forms) is fitted on a bounded sample of labelled texts.  Sentences of the sample
that name a group are copied with the name swapped for another of its kind, and the squared change of the
logit between the two is part of the loss: naming a group as such moves the score little.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from montevar.llm import common
from montevar.llm.common import forget, portions

#: The classifier is fitted on a bounded sample: at most so many labelled texts, the words (and beginnings) of them that tell
#: the classes apart best, and so many of their counterfactual pairs, taken by hash.
SAMPLE_TEXTS, FEATURES, MAX_PAIRS = 20_000, 4_096, 50_000
MIN_TEXTS = 3
#: The ridge is a prior: its weight against the mean loss falls with the number of texts.
RIDGE, FAIRNESS = 0.2, 5.0
BEGINNINGS = (3, 4, 5)
STEPS, RATE = 200, 0.1
# Names of groups of people, by kind and language; a name is swapped for the others of its kind.
IDENTITIES = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "native"), ("immigrants", "refugees", "natives"),
    ("disabled", "blind", "deaf"), ("old", "young"),
    ("american", "mexican", "chinese", "indian", "german", "french", "russian"),
    # French
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"), ("chrétienne", "musulmane", "juive"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"), ("noir", "blanc", "asiatique", "arabe", "africain", "européen"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"), ("femme", "homme"), ("femmes", "hommes"),
    ("fille", "garçon"), ("filles", "garçons"), ("homosexuel", "hétérosexuel", "lesbienne"), ("immigré", "réfugié"), ("immigrés", "réfugiés"),
    ("handicapé", "aveugle", "sourd"), ("américain", "mexicain", "chinois", "indien", "allemand", "français", "russe"),
    # German
    ("christ", "muslim", "jude", "hindu", "buddhist", "atheist"), ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("christlich", "muslimisch", "jüdisch", "buddhistisch"), ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("frau", "mann"), ("frauen", "männer"), ("mädchen", "junge"), ("schwul", "lesbisch", "hetero"), ("einwanderer", "flüchtlinge"),
    ("behindert", "blind", "taub"), ("amerikaner", "mexikaner", "chinesen", "inder", "deutsche", "franzosen", "russen"),
    # Spanish
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negro", "blanco", "asiático", "árabe", "africano", "europeo"), ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("chica", "chico"), ("chicas", "chicos"), ("homosexual", "heterosexual", "lesbiana"),
    ("inmigrante", "refugiado"), ("inmigrantes", "refugiados"), ("discapacitado", "ciego", "sordo"),
    ("americano", "mexicano", "chino", "indio", "alemán", "francés", "ruso"),
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features_of(words: set[str]) -> set[str]:
    """The words and their beginnings, which a star marks."""
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in BEGINNINGS))


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def counterfactuals(text: str, identities=IDENTITIES) -> Iterator[tuple[frozenset, frozenset]]:
    """Word sets of each sentence that names a group, and of the sentence with the name swapped."""
    others: dict[str, tuple] = {}
    for kind in identities:                                         # some names are the same in two languages
        for name in kind:
            others[name] = (*others.get(name, ()), *(x for x in kind if x not in others.get(name, ())))
    for sentence in _SENTENCE.split(text.lower()):
        words = set(_WORD.findall(sentence))
        for name in sorted(words & others.keys()):
            for other in others[name]:
                if other != name:
                    yield frozenset(words), frozenset(words - {name} | {other})


class Sparse:
    """Rows of feature numbers; products without a dense matrix."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, dtype=np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=r[self.row], minlength=self.width)


def train(rows: list[np.ndarray], labels: np.ndarray, pairs: tuple[list[np.ndarray], list[np.ndarray]], width: int,
          fairness: float = FAIRNESS, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias: mean log loss + ridge / number of texts + ``fairness`` times the mean squared change of the logit on a swap."""
    x, one, two = Sparse(rows, width), Sparse(pairs[0], width), Sparse(pairs[1], width)
    w, bias = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        error = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30))) - labels
        grad = x.back(error) / x.n + 2 * ridge / x.n * w
        if one.n and fairness:
            change = one.dot(w) - two.dot(w)
            grad += 2 * fairness * (one.back(change) - two.back(change)) / one.n
        full = np.append(grad, error.mean())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, identities=IDENTITIES, fairness: float = FAIRNESS) -> tuple[dict, float]:
    """Weight of each word kept, and the bias.

    ``labels`` has ``doc_id, toxic``; null labels are left out, several labels of a document give their
    mean.  The sample is the ``SAMPLE_TEXTS`` labelled ids that come first by a hash; equal texts count once.
    Without labelled rows of both classes the model is the bias alone.
    """
    marked = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
              .agg(F.avg("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_TEXTS))
    # At most SAMPLE_TEXTS ids, so the texts of the other documents are never moved.
    found = (docs.select(F.col("doc_id").alias("d"), F.col("text").alias("text"), F.xxhash64("text").alias("h"))
             .join(F.broadcast(marked), F.col("d") == F.col("doc_id")))
    # An id may stand for several texts: the bound holds for texts, too.
    last = found.select("h").distinct().orderBy("h").limit(SAMPLE_TEXTS).agg(F.max("h")).scalar()
    sample = (found.where(F.col("h") <= last).groupBy("h").agg(F.avg("y").alias("y"), F.first("text").alias("text"))
              .select("h", "text", (F.col("y") >= 0.5).cast("int").alias("y")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (part for whole in batches for part in portions(whole, "text", 1 << 20)):
            texts = batch.column("text").to_pylist()
            own = [sorted(features_of(words_of(t))) for t in texts]
            swaps = [sorted({(" ".join(sorted(a)), " ".join(sorted(b))) for a, b in counterfactuals(t or "", identities)})
                     for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("y"), pa.array(own, pa.list_(pa.string())),
                 pa.array([[{"a": a, "b": b} for a, b in s] for s in swaps],
                          pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())])))],
                ["h", "y", "words", "swaps"])

    seen = common.materialize(sample.mapInArrow(
        read, "h bigint, y int, words array<string>, swaps array<struct<a: string, b: string>>"), "labelled")
    n1, n = seen.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < n1 < n:
        return {}, 3.0 if n and n1 == n else -3.0
    n0 = n - n1
    odds = lambda a, b: F.log((a + 0.5) / (b + 0.5))
    word = (seen.select("y", F.explode("words").alias("word")).groupBy("word")
            .agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("k")).where(F.col("k") >= MIN_TEXTS)
            .withColumn("q", F.col("k") - F.col("p"))
            .withColumn("z", F.abs(odds(F.col("p"), n1 - F.col("p")) - odds(F.col("q"), n0 - F.col("q")))
                        / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))))
    vocabulary = [r["word"] for r in word.orderBy(F.desc("z"), "word").limit(FEATURES).select("word").collect()]
    at = {w: i for i, w in enumerate(vocabulary)}
    # Both results are bounded by the sample: feature numbers of its texts and of its swapped sentences.

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            rows = [[at[w] for w in own if w in at] for own in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("y"), pa.array(rows, pa.list_(pa.int32()))], ["h", "y", "x"])

    table = seen.select("h", "y", "words").mapInArrow(number, "h bigint, y int, x array<int>").orderBy("h").toArrow()
    rows = [np.array(x, dtype=np.int64) for x in table["x"].to_pylist()]
    swapped = (seen.select(F.explode("swaps").alias("s")).select("s.a", "s.b").distinct()
               .orderBy(F.xxhash64("a", "b"), "a", "b").limit(MAX_PAIRS).toArrow())
    sides = [[np.array([at[w] for w in sorted(features_of(set(s.split()))) if w in at], dtype=np.int64)
              for s in swapped[c].to_pylist()] for c in ("a", "b")]
    w, bias = train(rows, np.array(table["y"].to_pylist(), dtype=np.float64), (sides[0], sides[1]), len(vocabulary), fairness)
    return dict(zip(vocabulary, w.tolist())), bias


def score(docs: DataFrame, model: tuple[dict, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the toxicity score (0 to 1) of each whole text.

    Null and empty texts get the score of no words.  Rows are kept as they are, repeated ones too; a column named
    like the new one is replaced; an empty table gives an empty result.
    """
    weights, bias = model
    src = docs.drop(score_col)
    at = src.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        keys = weights.keys()
        for batch in batches:
            texts = batch.column(at)
            logit = np.array([bias + sum(weights[w] for w in sorted(features_of(words_of(texts[i].as_py())) & keys))
                              for i in range(batch.num_rows)], dtype=np.float64)
            found = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, score_col])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(score_col, T.DoubleType())]))


def _trained(spark, docs: DataFrame, sf_dir: str) -> tuple[dict, float]:
    labels = common.table(spark, sf_dir, "labels").where(common.crc32_of(F.col("doc_id")) % 5 != 0)
    return fit(docs.select("doc_id", "text"), labels)


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract query: toxicity of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(common.crc32_of(F.col("doc_id")) % 5 == 0, F.lit(False))
    out = score(docs.select("doc_id", held_out.alias("held_out"), "text"), _trained(spark, docs, sf_dir))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go.

    Rows go by their text alone: null and empty texts score like no words, repeated rows and rows without id stay or go together
    with equal texts; an empty table gives an empty result; other columns are kept as they are.
    """
    with common.Scratch(spark):
        model = _trained(spark, docs, sf_dir)
    out = score(docs, model, score_col="__toxicity")
    return out.where(F.col("__toxicity") < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
