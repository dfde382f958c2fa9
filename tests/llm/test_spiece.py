"""SentencePiece on the tokenizers library: parity with the reference implementation, exact round trips, edge rows."""
import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st

from montevar.llm import spiece
from tests.llm.helpers import documents, prose, rng

PATH = public_tokenizers.path(spiece.MODEL)
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = spiece.Codec(PATH)
signs = st.sampled_from([" ", "  ", "   ", "\n", "\t", "a", "the", "foo", "é", "é", "漢", "🙂", "<s>", "</s>", "<0x0A>", "▁", "<unk>",
                         "\x00", ".", "\xa0", "The", "ing"])


def numbers(ids):
    return np.frombuffer(ids, dtype="<u4").tolist()


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(signs, max_size=12).map("".join), min_size=1, max_size=3))
def test_parity(texts):
    want = SP.encode(texts)
    assert [numbers(i) for i in CODEC.encode(texts)] == want
    assert [numbers(i) for i in CODEC._batch(texts)] == want         # whole texts through the library alone
    for text, ids in zip(texts, want):
        raw = np.array(ids, dtype="<u4").tobytes()
        text = text.replace(spiece.SPACE, " ")                        # the format's marker sign
        assert CODEC.decode(raw) == SP.decode(ids) == text
        assert CODEC.backend.decode(ids, skip_special_tokens=True) == text


def test_long_text_and_any_ids():
    text = prose(rng(1), 60_000) + "x" * 20_000
    assert numbers(CODEC.encode([text])[0]) == SP.encode(text)
    r = rng(2)
    for _ in range(200):
        ids = r.integers(3, len(CODEC.spec.pieces), 12).tolist()
        assert CODEC.decode(np.array(ids, dtype="<u4").tobytes()) == SP.decode(ids)


def test_unigram_models_are_rebuilt():
    """A hand-made unigram model: the path of the largest score sum, unknown signs as bytes."""
    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3 & 127 | 128 if number > 15 else number << 3] + ([number >> 4] if number > 15 else [])) + bytes([value])
        return bytes([number << 3 | 2, len(value)]) + value

    def piece(text, score, kind=1):
        import struct
        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + field(3, kind))

    model = piece("<unk>", 0, 2) + b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    model += b"".join(piece(p, s) for p, s in (("▁", -2.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("▁ab", -9.0), ("ba", -2.5)))
    model += field(2, field(3, 1) + field(35, 1)) + field(3, field(3, 1) + field(4, 0))
    spec = spiece.Spec(model)
    tok = spiece.build(spec)
    own = sentencepiece.SentencePieceProcessor()
    own.LoadFromSerializedProto(model)
    for text in ("ab", "aba", "bab ab", "é", "a  b", ""):
        assert tok.encode(text, add_special_tokens=False).ids == own.encode(text), text


def test_rows(spark):
    rows = [(1, "Hello  world\n é"), (1, "Hello  world\n é"), (2, None), (3, ""), (None, "▁x"), (4, "word " * 40_000)]
    docs = documents(spark, rows).withColumnRenamed("source", "ids")
    coded = spiece.encode(docs)
    want = sorted((str(i), SP.encode(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in coded.collect()) == want
    back = spiece.decode(coded).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), (t or "").replace(spiece.SPACE, " ")) for i, t in rows)
    assert spiece.encode(docs.limit(0)).count() == 0
