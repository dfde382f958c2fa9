"""SentencePiece models on the tokenizers library.

The model's protobuf is read field by field and rebuilt from library parts: normaliser, marker of white space,
pieces with their scores (unigram, or merges in score order for byte-pair models) and byte fallback.
Encoding goes to the library in batches, which it spreads over threads; words
met before are remembered.  Decoding joins the bytes of the pieces.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from montevar.llm import common
from montevar.llm.common import per_process, portions

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words whose ids a task remembers; further words are encoded each time they occur.
WORDS_KEPT = 250_000
# Field numbers and kinds of the public model format.
PIECES, TRAINER, NORMALISER = 1, 2, 3
MODEL_TYPE, WHITE_AS_SUFFIX, BYTE_FALLBACK, UNK_ID = 3, 24, 35, 40
CHARSMAP, DUMMY_PREFIX, ONE_SPACE, ESCAPE_SPACE = 2, 3, 4, 5
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[wire]
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class Spec:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for field, value in fields(data):
            if field == PIECES:
                own = dict(fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                self.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif field == TRAINER:
                trainer = dict(fields(value))
            elif field == NORMALISER:
                normaliser = dict(fields(value))
        self.kind = trainer.get(MODEL_TYPE, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or trainer.get(WHITE_AS_SUFFIX, 0):
            raise ValueError("only unigram and byte-pair models with white space before the word are read")
        self.byte_fallback = bool(trainer.get(BYTE_FALLBACK, 0))
        self.unk = trainer.get(UNK_ID, 0)
        self.charsmap = normaliser.get(CHARSMAP, b"")
        self.dummy_prefix = bool(normaliser.get(DUMMY_PREFIX, 1))
        self.one_space = bool(normaliser.get(ONE_SPACE, 1))
        if not normaliser.get(ESCAPE_SPACE, 1):
            raise ValueError("models that leave white space unmarked are not read")
        #: Only these are matched in a text: the strings of control and byte pieces are ordinary text.
        self.matched = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER, UNUSED)}


def build(spec: Spec):
    """The model as a ``tokenizers.Tokenizer``."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    if spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], spec.unk, spec.byte_fallback)
    else:
        merges = []
        for piece, score in spec.matched.items():
            merges += [(-score, vocab[piece], k, (piece[:k], piece[k:])) for k in range(1, len(piece))
                       if piece[:k] in spec.matched and piece[k:] in spec.matched]
        model = models.BPE(vocab, [m[-1] for m in sorted(merges)], unk_token=spec.pieces[spec.unk][0],
                           fuse_unk=True, byte_fallback=spec.byte_fallback)
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.one_space:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    if not joins_words(spec):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    tok.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
                                    + [decoders.Strip(" ", 1, 0)] * spec.dummy_prefix)
    return tok


def joins_words(spec: Spec) -> bool:
    """True if a piece reaches over the start of a word; otherwise words are encoded one by one."""
    return any(SPACE in p.lstrip(SPACE) for p in spec.matched)


class Codec:
    """Ids (little-endian 32-bit bytes) of texts, and texts of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"               # batches are shared out to threads
        with open(path, "rb") as f:                                 # the file is part of an installed library
            self.spec = Spec(f.read())
        self.backend = build(self.spec)
        # Words stand alone if no piece spans two, and the normaliser leaves spaces as they are.
        self.by_word = not joins_words(self.spec) and self.spec.dummy_prefix and not (
            self.spec.charsmap or self.spec.one_space) and self.spec.kind == BPE
        self.ids: dict[str, bytes] = {}
        out = []
        for piece, _, kind in self.spec.pieces:
            if kind == BYTE:
                out.append(bytes([int(piece[1:-1], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            else:
                out.append((" ⁇ " if kind == UNKNOWN else piece.replace(SPACE, " ")).encode())
        self.bytes = out

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.backend.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Whole texts; in a batch, what is not remembered goes to the library at once."""
        if not self.by_word:
            return self._batch(texts)
        split, missing, known = [], {}, self.ids
        whole = dict.fromkeys(t for t in texts if SPACE in t)       # the marker itself as a sign of the text
        for text in texts:
            if text in whole:
                split.append([])
                continue
            words = text.split(" ") if text else []
            if "" in words:                                         # runs of spaces belong to the next word
                joined, run = [], ""
                for k, word in enumerate(words):
                    if word or k == len(words) - 1:
                        joined.append(run + word)
                        run = ""
                    else:
                        run += " "
                words = joined
            split.append(words)
            for word in words:
                if word not in known:
                    missing[word] = None
        found = known
        if missing:
            order = list(missing)
            fresh = dict(zip(order, self._batch([w if w else " " for w in order])))
            if "" in fresh:                                         # one trailing space: the marker alone
                fresh[""] = int(self.backend.token_to_id(SPACE)).to_bytes(4, "little")
            found = _Both(known, fresh)
            for word in order[:max(0, WORDS_KEPT - len(known))]:
                known[word] = fresh[word]
        if whole:
            whole = dict(zip(whole, self._batch(list(whole))))
        get = found.__getitem__
        return [whole[text] if text in whole else b"".join(map(get, words)) for text, words in zip(texts, split)]

    def decode(self, ids: bytes) -> str:
        pieces = self.bytes
        raw = b"".join([pieces[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.spec.dummy_prefix and text.startswith(" ") else text


class _Both(dict):
    """Remembered words first, then those of this batch."""

    def __init__(self, known: dict, fresh: dict):
        super().__init__(fresh)
        self.known = known

    def __missing__(self, word: str) -> bytes:
        return self.known[word]


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text in place of the text (an array of int).

    A null or empty text has no ids.  Rows are kept as they are, repeated ones too; a column named like the new one
    is replaced; an empty table gives an empty result.
    """
    src = docs.drop(ids_col) if ids_col != text_col else docs
    at = src.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for part in portions(batch, text_col):
                ids = codec.encode([t or "" for t in part.column(at).to_pylist()])
                cut = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                columns = [c for k, c in enumerate(part.columns) if k != at]
                names = [n for k, n in enumerate(part.schema.names) if k != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(cut, flat)], [*names, ids_col])

    kept = [f for f in src.schema.fields if f.name != text_col]
    return src.mapInArrow(run, T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``encoded`` with the text of each sequence of ids in place of the ids; null ids give an empty text."""
    src = encoded.drop(text_col) if ids_col != text_col else encoded
    at = src.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            lists = batch.column(at)
            texts = []
            for i in range(batch.num_rows):
                own = lists[i].values
                texts.append(codec.decode(own.to_numpy().astype("<u4").tobytes()) if own is not None else "")
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            names = [n for k, n in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*names, text_col])

    kept = [f for f in src.schema.fields if f.name != ids_col]
    return src.mapInArrow(run, T.StructType([*kept, T.StructField(text_col, T.StringType())]))


def _codec(model: str | None) -> Codec:
    import public_tokenizers
    path = model or public_tokenizers.path(MODEL)
    return per_process("spiece", path, lambda: Codec(path))


def op6(spark, sf_dir: str) -> DataFrame:
    """Query: every document encoded, and decoded again.

    ``doc_id, n_tokens, ids_crc32`` (little-endian unsigned 32-bit ids) and ``same`` (the decoded ids give the text;
    in the format a text's own marker sign is a space).
    """
    src = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(None)
        for batch in batches:
            for part in portions(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = codec.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                     pa.array([codec.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts)])],
                    ["doc_id", "n_tokens", "ids_crc32", "same"])

    return src.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, same boolean")
