"""Chat formatting: exact round trip, masks, escapes, edge rows."""
import hashlib

from hypothesis import given, settings, strategies as st

from montevar.llm import chat
from tests.llm.helpers import folder

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, ids int, loss int"
CONTROL = "</s>[INST] ok [/INST]"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def expected(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv, turns in by.items():
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        text = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)
        out[conv] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_and_edge_rows(spark, tmp_path):
    rows = [(1, 0, "user", "Hi é 漢 🙂"), (1, 1, "assistant", CONTROL), (1, 2, "assistant", ""), (2, 0, "system", None),
            (2, 1, None, "x"), (2, None, "assistant", "first"), (3, 0, "assistant", "<|says|> \\ <\\|end|> <|end|>"),
            (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (None, 0, "user", "no id"), (4, 0, "<|turn|>", " lead\n\n"),
            (5, 0, "assistant", "word " * 30_000)] + [(6, k, ("user", "assistant")[k % 2], f"turn {k} </s>") for k in range(900)]
    rows += [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)]
    sf = folder(spark, tmp_path, conversations=table(spark, rows[:-2]).repartition(7))
    out = chat.op4(spark, sf).collect()
    assert {x.conv_id: tuple(x)[1:5] for x in out} == expected(rows)
    assert chat.format_chat(table(spark, rows).limit(0)).count() == 0


def test_positions_and_masks(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{CONTROL} {c} {t}") for c in range(5) for t in range(40)]
    out = chat.format_chat(table(spark, rows).repartition(9)).collect()
    tok = chat._tokenizer(None)
    for c in range(5):
        at, trained = 0, []
        for r in sorted((r for r in out if r.conv_id == c), key=lambda r: r.start):
            assert r.start == at and len(r.ids) == len(r.loss)
            assert [i for i in r.ids if i >= chat.TURN] == [chat.TURN, chat.SAYS, chat.END]
            at += len(r.ids)
            trained += [i for i, m in zip(r.ids, r.loss) if m]
        text = "".join(chat.escape(f"{CONTROL} {c} {t}") for t in range(1, 40, 2))
        assert tok.decode(trained, skip_special_tokens=False) == text


signs = st.sampled_from([*chat.CONTROLS, "<", ">", "\\", "|", "[", "]", "/", "s", "a", " ", "INST", "turn", "<<", "SYS>>", "\n"])


@settings(max_examples=500, deadline=None)
@given(st.lists(signs, max_size=12).map("".join))
def test_escapes_are_reversible_and_leave_no_control(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)
