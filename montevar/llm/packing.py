"""Best-fit packing of tokenised documents into sequences of a fixed length.

The plan is made on counts, not on documents: a histogram of piece lengths (at most
``max_len`` rows, whatever the corpus) is packed best-fit, longest first, on the
driver.  Each planned slot stands for a run of pieces of one length, and the
pieces take their slots by their rank within the length.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from montevar.llm import common
from montevar.llm.common import per_process, portions  # functions: modules do not travel to executors

TOKENIZER = "word_bpe_49k.json"
END_ID = 0
MAX_LEN = 2048
#: Words whose ids a task remembers; further words are encoded each time they occur.
WORDS_KEPT = 400_000


# Fixed value: how the tokenizer's added tokens begin.
ADDED = "<|"


class WordEncoder:
    """Ids of whole texts from a tokenizer that never joins tokens across white space.

    A text's ids are then those of its words, one after another, so the ids of words met before are
    remembered (as little-endian 32-bit bytes) and the others go to the library in batches.  Two more facts about
    the tokenizer keep the words few: it lower-cases anyway, and it separates letters from other signs,
    so that a word before a full stop or comma is the word and the mark.  Both are used
    for Latin-1 texts only, where lower-casing does not depend on the context, and not for texts that may hold
    one of the tokenizer's added tokens, which it looks for before it lower-cases.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers import normalizers, pre_tokenizers
        os.environ["TOKENIZERS_PARALLELISM"] = "false"              # words are too short to share out: a task is one thread
        self.encode = Tokenizer.from_file(path).encode_batch_fast
        # Lower-case Latin-1 letters are one pre-token and already normal: the steps before the model pass them on.
        letters = Tokenizer.from_file(path)
        letters.normalizer = normalizers.Sequence([])
        letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.encode_letters = letters.encode_batch_fast
        self.known: dict[str, bytes] = {}

    def _batch(self, words: list[str], encode) -> dict[str, bytes]:
        found = (e.ids for e in encode(words, add_special_tokens=False))
        return {w: struct.pack(f"<{len(ids)}I", *ids) for w, ids in zip(words, found)}

    def __call__(self, texts: list[str]) -> list[bytes]:
        known, split, missing, new = self.known, [], {}, {}
        for text in texts:
            try:
                text.encode("latin-1")
                latin = ADDED not in text
            except UnicodeEncodeError:
                latin = False
            text = text.lower() if latin else text
            words = text.replace("\n", " ").split(" ")
            parts = list(map(known.get, words))
            if None in parts:
                at = [k for k, found in enumerate(parts) if found is None]
                for word in {words[k] for k in at}:
                    if word not in new:
                        stem = word[:-1] if latin and word[-1:] in (".", ",") and word[:-1].isalpha() else None
                        new[word] = stem
                        for part in (word,) if stem is None else (stem, word[-1]):
                            if part not in known:
                                missing[part] = missing.get(part, True) and latin and part.isalpha()
                split.append((parts, [(k, words[k]) for k in at]))
            else:
                split.append((parts, ()))
        if missing:
            letters, others = ([w for w, plain in missing.items() if plain == kind] for kind in (True, False))
            missing = self._batch(letters, self.encode_letters) | self._batch(others, self.encode)
        if new:
            ids = lambda w: known[w] if w in known else missing[w]
            new = {w: ids(w) if stem is None else ids(stem) + ids(w[-1]) for w, stem in new.items()}
            for parts, at in split:
                for k, word in at:
                    parts[k] = new[word]
            for more in (missing, new):
                if len(known) < WORDS_KEPT:
                    known.update(more)
        return [b"".join(parts) for parts, _ in split]


def pieces(docs: DataFrame, max_len: int = MAX_LEN, end_id: int = END_ID, tokenizer: str | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document, with its rank among the pieces of its length in its task."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        path = tokenizer or public_tokenizers.path(TOKENIZER)
        encode = per_process("packing", path, lambda: WordEncoder(path))
        end = int(end_id).to_bytes(4, "little")
        part, seen = TaskContext.get().partitionId(), np.zeros(max_len + 1, dtype=np.int64)
        for batch in batches:
            rows: list[tuple] = []
            coded = ((part.column("doc_id")[i].as_py(), ids + end) for part in portions(batch, "text", 1 << 21)
                     for i, ids in enumerate(encode([t or "" for t in part.column("text").to_pylist()])))
            for doc_id, ids in coded:
                for piece, at in enumerate(range(0, len(ids), 4 * max_len)):
                    own = ids[at:at + 4 * max_len]
                    n = len(own) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(own), seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.schema.field("doc_id").type), pa.array(cols[1], pa.int32())]
                + [pa.array(c, pa.int64()) for c in cols[2:]] + [pa.array([part] * len(rows), pa.int32())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, "
                               "length bigint, ids_crc32 bigint, nth bigint, part int")


def plan(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit over counts, longest pieces first.

    Returns runs ``(length, first, n, sequence, per, offset)``: the pieces of ``length`` with ranks
    ``first .. first + n - 1`` go, ``per`` to a sequence, into consecutive sequences from
    ``sequence``, from ``offset`` on.  Open sequences are kept as runs by free room, so
    the work depends on the number of different lengths only.
    """
    runs, room, total = [], {}, 0               # room: free tokens -> [(first sequence, how many)]
    for length in sorted(counts, reverse=True):
        left, first = counts[length], 0
        while left:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                per = max_len // length
                full, rest = divmod(left, per)
                if full:
                    runs.append((length, first, full * per, total, per, 0))
                    room.setdefault(max_len - per * length, []).append((total, full))
                    first, total = first + full * per, total + full
                if rest:
                    runs.append((length, first, rest, total, rest, 0))
                    room.setdefault(max_len - rest * length, []).append((total, 1))
                    total += 1
                left = 0
            else:
                start, n = room[free].pop()
                if not room[free]:
                    del room[free]
                per = free // length
                full, rest = divmod(left, per)
                used = min(n, full)
                if used:
                    runs.append((length, first, used * per, start, per, max_len - free))
                    room.setdefault(free - per * length, []).append((start, used))
                    first, left = first + used * per, left - used * per
                if used < n and left:           # fewer pieces than one sequence takes
                    runs.append((length, first, left, start + used, left, max_len - free))
                    room.setdefault(free - left * length, []).append((start + used, 1))
                    used, left = used + 1, 0
                if used < n:
                    room.setdefault(free, []).append((start + used, n - used))
            room.pop(0, None)
    return runs


def pack(docs: DataFrame, max_len: int = MAX_LEN, end_id: int = END_ID, tokenizer: str | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    A document is its ids followed by ``end_id``; only a longer one is cut, into pieces of
    ``max_len`` of which the last may be shorter.  A null or empty text is the end id alone;
    repeated rows are packed as often as they occur, null ids included; an empty table
    gives an empty result; other columns are ignored.

    The rank of a piece within its length is the number of such pieces in earlier tasks plus its number
    within its task, so a length that a third of all pieces share needs no single sort.
    """
    cut = common.materialize(pieces(docs, max_len, end_id, tokenizer, id_col, text_col), "pieces")
    by_part = common.checkpoint(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    # At most max_len rows, by construction of the pieces.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = (by_part.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce("before", F.lit(0)).alias("before")))
    ranked = cut.join(before, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    runs = np.array(sorted(plan(counts, max_len)), dtype=np.int64).reshape(-1, 6)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A run starts at (length, first rank); one search over both finds a piece's run.
        scale = int(runs[:, 1].max(initial=0)) + 1
        starts = runs[:, 0].astype(object) * scale + runs[:, 1] if scale > (1 << 51) else runs[:, 0] * scale + runs[:, 1]
        for pdf in batches:
            rank, length = pdf.pop("rank").to_numpy(), pdf["length"].to_numpy()
            at = np.searchsorted(starts, length * scale + np.minimum(rank, scale - 1), side="right") - 1
            nth, per = rank - runs[at, 1], runs[at, 4]
            pdf["sequence_id"] = runs[at, 3] + nth // per
            pdf["offset"] = runs[at, 5] + nth % per * length
            yield pdf

    return ranked.mapInPandas(place, ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
        + ", sequence_id bigint, offset bigint")


def op10(spark, sf_dir: str) -> DataFrame:
    """Contract query: every piece of every document and its place."""
    return pack(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of the remaining documents.

    A null or empty text is one piece of its end id alone; rows that share an id are packed each for itself; an empty
    table gives an empty result; other columns are dropped.
    """
    return pack(docs)
