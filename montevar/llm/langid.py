"""Language identification: words first, character n-grams for words never seen.

A known word scores by its log frequency in each language; an unseen word falls back to its character
n-grams, the longest length first, and the first length with a known n-gram decides.  Counts cover the
whole training text and none is dropped: each task holds the most frequent words and n-grams, a bounded number of them, and
the rest are tables that a text's other words are joined with, each different word once.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from montevar.llm import common
from montevar.llm.common import forget, per_process

UNDETERMINED = "und"
LONGEST_GRAM = 4
#: Entries that a task holds, each with its counts in all languages; the others are looked up by joins.
MAX_WORDS, MAX_GRAMS = 160_000, 80_000
#: Counts that a training task holds before it hands them on.
HELD = 200_000
SMOOTHING = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def _grams(word: str, n: int) -> list[str]:
    if n == 1:                                                      # the marks of a word's ends alone say nothing
        return list(word)
    padded = f"<{word}>"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)] or [padded]


def _sums(schema: pa.Schema, batches: Iterator[pa.RecordBatch], count) -> Iterator[pa.RecordBatch]:
    """Partial sums of what ``count(batch, held)`` adds to ``held[lang]``, handed on in bounded portions."""
    forget()
    held: dict[str, Counter] = defaultdict(Counter)

    def hand_on():
        for lang, own in held.items():
            items = list(own)
            for lo in range(0, len(items), 50_000):
                part = items[lo:lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()),
                     pa.array([own[w] for w in part], pa.int64())], schema=schema)
        held.clear()

    for batch in batches:
        for _ in count(batch, held):
            if sum(map(len, held.values())) > HELD:
                yield from hand_on()
    yield from hand_on()


def _split(counts: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """``item, all, by_lang`` of ``lang, item, n``: at most ``most`` of the most frequent items, and the others if any.

    The threshold comes from a histogram of counts in steps of an eighth of a power of two, so the items
    are never sorted in one task.
    """
    items = common.materialize(counts.groupBy("item").agg(
        F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")), name)
    step = F.floor(F.log2("all") * 8).cast("int")
    steps = items.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()      # at most 8 * 63
    total, least = 0, 8 * 64
    for r in sorted(steps, key=lambda r: -r["step"]):
        if total + r["k"] > most:
            break
        total, least = total + r["k"], r["step"]
    rest = None if total == sum(r["k"] for r in steps) else items.where(step < least)
    return items.where(step >= least), rest


class Model:
    """Log frequencies of words and n-grams; plain lists and arrays, bounded by MAX_WORDS and MAX_GRAMS.

    ``rare_words`` and ``rare_grams`` are the tables ``item, scores`` of the others, or None where there are none.
    """

    rare_words: DataFrame | None = None
    rare_grams: DataFrame | None = None

    def __init__(self, langs, prior, words, word_scores, grams, gram_scores):
        self.langs, self.prior = langs, prior
        self.words, self.word_scores = words, word_scores
        self.grams, self.gram_scores = grams, gram_scores

    def held(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not isinstance(v, DataFrame)}

    def ready(self) -> "Model":
        self.word_at = {w: i for i, w in enumerate(self.words)}
        self.gram_at = {g: i for i, g in enumerate(self.grams)}
        return self

    def grams_of(self, word: str) -> tuple[int, np.ndarray, int, list[str]]:
        """Length and summed scores of the longest held n-grams, their number, and the others that are as long or longer."""
        others = []
        for n in range(LONGEST_GRAM, 0, -1):
            own = [g for g in _grams(word, n) if len(g) == n]
            known = [i for g in own if (i := self.gram_at.get(g)) is not None]
            others += [g for g in own if g not in self.gram_at]
            if known:
                return n, self.gram_scores[known].sum(axis=0, dtype=np.float64), len(known), others
        return 0, np.zeros(len(self.langs)), 0, others

    def held_evidence(self, text: str) -> tuple[np.ndarray, int, list[tuple[str, int]]]:
        """Sum of the scores of the held words, their occurrences, and the other words with theirs; nothing without a letter."""
        found, total, others = words_of(text), np.zeros(len(self.langs)), []
        at, times = [], []
        if not any(c.isalpha() for w in found for c in w):
            return total, 0, others
        for word, k in found.items():
            i = self.word_at.get(word)
            if i is None:
                others.append((word, k))
            else:
                at.append(i)
                times.append(k)
        if at:
            total = np.array(times, dtype=np.float64) @ self.word_scores[at]
        return total, sum(times), others


def _log_frequencies(items: pa.Table, langs: list[str], totals: dict[str, float], size: int) -> tuple[list[str], np.ndarray]:
    """Sorted items and their log frequencies, of ``size`` different ones in all."""
    maps = items["by_lang"].to_pylist()
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(maps), len(langs)))
    for row, own in enumerate(maps):
        for lang, n in own:
            counts[row, place[lang]] = n
    all_n = np.array([totals.get(lang, 0) for lang in langs])
    order = pc.sort_indices(items["item"]).to_numpy()
    scores = np.log((counts + SMOOTHING) / (all_n + SMOOTHING * max(size, 1)))
    return items["item"].take(pa.array(order)).to_pylist(), scores[order]


def _scored(items: DataFrame | None, langs: list[str], shares: list[list[float]], size: Column) -> DataFrame | None:
    """``item, scores`` of a table of counts; ``shares`` holds what counts are divided by, for each size and language."""
    if items is None:
        return None
    return items.select("item", F.array(*[
        F.log((F.coalesce(F.col("by_lang")[lang], F.lit(0)) + SMOOTHING)
              / F.element_at(F.array(*[F.lit(float(own[k])) for own in shares]), size)) for k, lang in enumerate(langs)]).alias("scores"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS,
        max_grams: int = MAX_GRAMS) -> Model:
    """Counts words by language over all rows with a text and a language, then n-grams over the distinct words.

    Rows without text or language teach nothing, repeated rows count as often as they occur; without any row the model knows no
    language but ``und``.  Whole texts are counted; other columns are ignored.
    """
    src = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL")
    schema = pa.schema([("lang", pa.string()), ("item", pa.string()), ("n", pa.int64())])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count(batch, held):
            langs, texts = batch.column("lang"), batch.column("text")
            for i in range(batch.num_rows):
                held[langs[i].as_py()].update(_WORD.findall(texts[i].as_py().lower()))
                yield
        return _sums(schema, batches, count)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count(batch, held):
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "item", "n"))):
                own = held[lang]
                for size in range(1, LONGEST_GRAM + 1):
                    for gram in _grams(word, size):
                        own[gram] += n
                yield
        return _sums(schema, batches, count)

    total = lambda df: df.groupBy("lang", "item").agg(F.sum("n").alias("n"))
    words = common.materialize(total(src.mapInArrow(count_words, "lang string, item string, n bigint")), "words")
    grams = common.materialize(total(words.mapInArrow(count_grams, "lang string, item string, n bigint")), "grams")
    sums = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sums)
    if not langs:
        return Model([UNDETERMINED], np.ones(1), [], np.zeros((0, 1)), [], np.zeros((0, 1)))
    frequent, rare = _split(words, max_words, "vocabulary")
    n_words = words.select("item").distinct().count()
    kept_words, word_scores = _log_frequencies(frequent.toArrow(), langs, sums, n_words)
    frequent_grams, rare_grams = _split(grams.where(F.length("item") <= LONGEST_GRAM), max_grams, "gram-vocabulary")
    known = frequent_grams.toArrow()
    sizes = pc.utf8_length(known["item"])
    by_size = {(r["lang"], r["size"]): r["n"] for r in grams.groupBy("lang", F.length("item").alias("size")).agg(
        F.sum("n").alias("n")).collect()}
    different = {r["size"]: r["k"] for r in grams.select("item").distinct().groupBy(F.length("item").alias("size")).agg(
        F.count(F.lit(1)).alias("k")).collect()}
    names, scores, shares = [], [np.zeros((0, len(langs)))], []
    for size in range(1, LONGEST_GRAM + 1):
        totals = {lang: by_size.get((lang, size), 0) for lang in langs}
        own, frequency = _log_frequencies(known.filter(pc.equal(sizes, size)), langs, totals, different.get(size, 0))
        shares.append([totals[lang] + SMOOTHING * max(different.get(size, 0), 1) for lang in langs])
        names += own
        scores.append(frequency)
    prior = np.array([sums[lang] for lang in langs], dtype=np.float64)
    model = Model(langs, prior / prior.sum(), kept_words, word_scores, names, np.concatenate(scores))
    model.rare_words = _scored(rare, langs, [[sums[lang] + SMOOTHING * n_words for lang in langs]], F.lit(1))
    model.rare_grams = _scored(rare_grams, langs, shares, F.length("item"))
    return model


def _sum_of(col: str, n: int, times: Column | None = None) -> Column:
    """Element-wise sum of arrays of ``n`` numbers."""
    one = lambda k: F.col(col)[k] if times is None else F.col(col)[k] * times
    return F.array(*[F.sum(one(k)) for k in range(n)])


def _unseen_scores(unseen: DataFrame, model: Model, load, name: str) -> DataFrame:
    """``word, scores`` of the words ``item`` from their longest known n-grams."""
    n = len(model.langs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = per_process("langid", name, load)
        for batch in batches:
            words = batch.column(0).to_pylist()
            cols = list(zip(*map(own.grams_of, words))) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int32()), pa.array([list(x) for x in cols[1]], pa.list_(pa.float64())),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.string()))], ["word", "size", "scores", "n", "others"])

    held = unseen.mapInArrow(cut, "word string, size int, scores array<double>, n bigint, others array<string>")
    found = held.select("word", "size", "scores", "n").where("n > 0")
    if model.rare_grams is not None:
        held = common.materialize(held, "unseen")
        rare = held.select("word", F.explode("others").alias("gram")).join(
            model.rare_grams.hint("merge"), F.col("gram") == F.col("item"))
        found = held.select("word", "size", "scores", "n").where("n > 0").unionByName(
            rare.select("word", F.length("gram").alias("size"), "scores", F.lit(1).cast("bigint").alias("n")))
    by_size = found.groupBy("word", "size").agg(_sum_of("scores", n).alias("scores"), F.sum("n").alias("n"))
    mean = F.array(*[F.col("scores")[k] / F.col("n") for k in range(n)])
    return by_size.groupBy("word").agg(F.max_by(mean, F.col("size")).alias("scores"))


def _predictions(src: DataFrame, text_col: str, key: Column, model: Model, load, name: str) -> DataFrame:
    """``__key, __pred, __share`` of each different text that has a letter."""
    n = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = per_process("langid", name, load)
        rest = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))
        for batch in batches:
            texts = batch.column(1)
            found = [own.held_evidence(texts[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(f[0]) for f in found], pa.list_(pa.float64())),
                 pa.array([f[1] for f in found], pa.int64()),
                 pa.array([[{"word": w, "k": k} for w, k in f[2]] for f in found], rest)], ["key", "total", "n", "rest"])

    texts = src.select(key.alias("key"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    held = texts.mapInArrow(run, "key string, total array<double>, n bigint, rest array<struct<word string, k bigint>>")
    held = common.materialize(held.groupBy("key").agg(*[F.first(c).alias(c) for c in ("total", "n", "rest")]), "evidence")
    held = held.where("n > 0 OR size(rest) > 0")
    rest = held.select("key", F.explode("rest").alias("r")).select("key", "r.word", "r.k")
    words = rest.select(F.col("word").alias("item")).distinct()
    scored = None
    if model.rare_words is not None:
        words = common.materialize(words, "rest")
        scored = model.rare_words.join(words.hint("merge"), "item", "left_semi").select(F.col("item").alias("word"), "scores")
        words = words.join(model.rare_words.select("item").hint("merge"), "item", "left_anti")
    unseen = _unseen_scores(words, model, load, name)
    scored = unseen if scored is None else scored.unionByName(unseen)
    more = (rest.join(scored.withColumnRenamed("word", "w").hint("merge"), F.col("word") == F.col("w"))
            .groupBy(F.col("key").alias("of")).agg(_sum_of("scores", n, F.col("k")).alias("more"), F.sum("k").alias("k")))
    both = held.select("key", "total", "n").join(more, F.col("key") == F.col("of"), "left").select(
        "key", (F.col("n") + F.coalesce("k", F.lit(0))).alias("n"),
        F.array(*[F.col("total")[j] + F.coalesce(F.col("more")[j], F.lit(0.0)) for j in range(n)]).alias("total"))
    top = F.array_max("total")
    spread = sum((F.exp((F.col("total")[j] - top) / F.sqrt("n")) for j in range(n)), F.lit(0.0))
    langs = F.array(*[F.lit(lang) for lang in model.langs])
    return both.select(
        F.col("key").alias("__key"),
        F.when(F.col("n") > 0, F.element_at(langs, F.array_position("total", top).cast("int"))).otherwise(
            F.lit(model.langs[int(model.prior.argmax())])).alias("__pred"),
        F.when(F.col("n") > 0, 1 / spread).otherwise(F.lit(1 / n)).alias("__share"), F.col("n").alias("__n"))


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred",
             score_col: str = "score", evidence_col: str | None = None) -> DataFrame:
    """``docs`` with the predicted language and its share of the evidence (0 to 1); ``evidence_col`` names a column for
    the number of its words that are known or have a known n-gram.

    A text that is null or has no letter is ``und`` with score 0.  Rows are kept as they are, repeated ones
    too; columns named like the new ones are replaced; an empty table gives an empty result.
    """
    shared = common.share(docs.sparkSession, model.held())
    more = [evidence_col] if evidence_col else []
    src = docs.drop(pred_col, score_col, *more)
    name = uuid.uuid4().hex

    def load() -> Model:
        own = Model.__new__(Model)
        own.__dict__.update(shared.value)
        return own.ready()

    key = F.md5(F.encode(F.col(text_col), "utf-8"))
    found = _predictions(src, text_col, key, model, load, name)
    return src.withColumn("__text_key", key).join(found, F.col("__text_key") == F.col("__key"), "left").select(
        *[F.col(f"`{c}`") for c in src.columns], F.coalesce("__pred", F.lit(UNDETERMINED)).alias(pred_col),
        F.coalesce("__share", F.lit(0.0)).alias(score_col), *[F.coalesce("__n", F.lit(0)).alias(c) for c in more])


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(common.crc32_of(F.col("doc_id")) % 4 != 2)


def op2(spark, sf_dir: str) -> DataFrame:
    """Contract query: predicted language of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(_training(docs))
    held_out = F.coalesce(common.crc32_of(F.col("doc_id")) % 4 == 2, F.lit(False))
    out = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without a letter, and texts of which no word and no n-gram is known in any learned language, go.

    Null and empty texts go with them; repeated rows and rows without id stay or go by their text alone; rows without a language
    teach nothing; an empty table gives an empty result; other columns are kept as they are.
    """
    # A text's digest stands for it: what is kept of this stage is one row for each different text that stays.
    digest = F.md5(F.encode("text", "utf-8"))
    with common.Scratch(spark) as own:
        model = fit(_training(docs))
        out = identify(docs.select(digest.alias("__digest"), "text"), model, "text", "__lang_pred", "__lang_score", "__known")
        kept = own.result(out.where((F.col("__lang_pred") != UNDETERMINED) & (F.col("__known") > 0))
                          .select("__digest").distinct(), "language-kept")
    return docs.withColumn("__of", digest).join(kept, F.col("__of") == F.col("__digest"), "left_semi").drop("__of")
