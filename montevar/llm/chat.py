"""Chat formatting at token level.

Every segment (role, text) is encoded on its own and the reserved ids that mark turns are spliced in
between, so no text can form a mark across a boundary.  Loss masks are prefix sums over the
boundaries of the trained segments.  Control strings inside texts are escaped reversibly, so that
the rendered conversation can be read back as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from montevar.llm import common
from montevar.llm.common import per_process

TOKENIZER = "byte_bpe_50k.json"
# Reserved ids behind the 50,257 of the vocabulary, and the strings that render them.
TURN, SAYS, END = 50257, 50258, 50259
MARKS = {TURN: "<|turn|>", SAYS: "<|says|>", END: "<|end|>"}
#: Control strings of common chat templates: none may appear unescaped in a segment.
CONTROLS = (*MARKS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
            "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
            "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<bos>", "<eos>",
            "<start_of_turn>", "<end_of_turn>", "<unk>", "<pad>")
TRAINED_ROLE = "assistant"
_FORMS = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in sorted(CONTROLS, key=len, reverse=True))
_ESCAPE = re.compile(_FORMS)
_CONTROL_SPLIT = 1


def escape(text: str) -> str:
    """One backslash more behind the first sign of each control string, however many there are."""
    return _ESCAPE.sub(lambda m: m[0][:_CONTROL_SPLIT] + "\\" + m[0][_CONTROL_SPLIT:], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][:1] + m[0][2:] if m[0][1:2] == "\\" else m[0], text)


def _tokenizer(name: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = name or public_tokenizers.path(TOKENIZER)

    def load():
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True                            # their strings in a text are ordinary text
        return tok

    return per_process("chat", path, load)


def format_chat(turns: DataFrame, trained_role: str = TRAINED_ROLE, tokenizer: str | None = None) -> DataFrame:
    """``conv_id, turn, start, ids, loss``: one row per turn of the formatted conversations.

    ``start`` is the turn's first position in its conversation; laid end to end in that order, ``ids`` is the
    token sequence and ``loss`` (1 on the tokens of trained texts) its mask.  A turn is ``TURN role SAYS
    text END``.  Turns come by ``turn``, ties by role and text; null roles and texts are empty; rows
    with a null conversation form one conversation, null turns come first; repeated rows
    stay; an empty table gives an empty result.  Other columns are ignored.

    Conversations are cut by ranges of (conversation, turn), so one that holds a third of all
    rows is spread over tasks; positions are prefix sums within a task plus those of the tasks before.
    """
    src = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("at", pa.int64()), ("part", pa.int32()),
                        ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.int8()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = _tokenizer(tokenizer), TaskContext.get().partitionId()
        last, at = None, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512).to_pylist()
                parts = [escape(s) for r in rows for s in (r["role"], r["text"])]
                codes = [e.ids for e in tok.encode_batch_fast(parts, add_special_tokens=False)]
                ids, edges, ends, starts = [], [], [], []
                for k, r in enumerate(rows):
                    if last is None or last != (r["conv_id"],):
                        last, at = (r["conv_id"],), 0
                    role, text = codes[2 * k], codes[2 * k + 1]
                    starts.append(at)
                    ids += [TURN, *role, SAYS]
                    if r["role"] == trained_role:
                        edges.append((len(ids), len(ids) + len(text)))
                    ids += [*text, END]
                    at += len(role) + len(text) + 3
                    ends.append(len(ids))
                step = np.zeros(len(ids) + 1, dtype=np.int8)
                for a, b in edges:
                    step[a] += 1
                    step[b] -= 1
                mask = np.cumsum(step)[:-1]
                cut = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["conv_id"] for r in rows], pa.int64()), pa.array([r["turn"] for r in rows], pa.int64()),
                     pa.array(starts, pa.int64()), pa.array([part] * len(rows), pa.int32()),
                     pa.ListArray.from_arrays(cut, pa.array(np.array(ids, dtype=np.int32))),
                     pa.ListArray.from_arrays(cut, pa.array(mask.astype(np.int8)))], schema=schema)

    dealt = src.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long"))
    coded = common.materialize(
        dealt.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(run, "conv_id bigint, turn bigint, at bigint, part int, ids array<int>, loss array<tinyint>"), "chat")
    # One row for each conversation and task it lies in.
    sums = coded.groupBy("conv_id", "part").agg(F.sum(F.size("ids")).alias("n"))
    before = sums.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(
        Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return (coded.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
            .select("conv_id", "turn", (F.col("before") + F.col("at")).alias("start"), "ids", "loss"))


def read_back(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``conv_id, start, role, text, loss_text, formatted_chars`` of each turn, from ids and mask alone.

    ``loss_text`` is null where nothing is trained on.
    """
    schema = "conv_id bigint, start bigint, role string, text string, loss_text string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer)
        for batch in batches:
            ids_col, loss_col = batch.column("ids"), batch.column("loss")
            out = {"role": [], "text": [], "loss_text": [], "formatted_chars": []}
            for i in range(batch.num_rows):
                ids = ids_col[i].values.to_numpy()
                mask = loss_col[i].values.to_numpy().astype(bool)
                says = int(np.flatnonzero(ids == SAYS)[0])
                role = tok.decode(ids[1:says].tolist(), skip_special_tokens=False)
                text = tok.decode(ids[says + 1:-1].tolist(), skip_special_tokens=False)
                trained = None
                if mask.any():
                    trained = unescape(tok.decode(ids[mask].tolist(), skip_special_tokens=False))
                out["role"].append(unescape(role))
                out["text"].append(unescape(text))
                out["loss_text"].append(trained)
                out["formatted_chars"].append(len(role) + len(text) + sum(map(len, MARKS.values())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("start"), *(pa.array(out[c], pa.string()) for c in (
                    "role", "text", "loss_text")), pa.array(out["formatted_chars"], pa.int64())],
                ["conv_id", "start", "role", "text", "loss_text", "formatted_chars"])

    return formatted.select("conv_id", "start", "ids", "loss").mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``read_back`` turns.

    A hash over a conversation reads its turns in order, so they pass through one task, one
    batch at a time: only running hashes are held, never a conversation.
    """
    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def row() -> pa.RecordBatch:
            conv_id, n, turns_hash, chars, loss_hash, total = state
            return pa.RecordBatch.from_pylist(
                [{"conv_id": conv_id, "n_turns": n, "turns_sha256": turns_hash.hexdigest(), "loss_chars": chars,
                  "loss_sha256": loss_hash.hexdigest(), "formatted_chars": total}],
                schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                                  ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                                  ("formatted_chars", pa.int64())]))

        done = []
        for batch in batches:
            columns = [batch.column(c) for c in ("conv_id", "role", "text", "loss_text", "formatted_chars")]
            for i in range(batch.num_rows):
                conv_id, role, text, trained, chars = (c[i].as_py() for c in columns)
                if state is None or state[0] != conv_id:
                    if state is not None:
                        done.append(row())
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if trained is not None:
                    state[3] += len(trained)
                    state[4].update(trained.encode("utf-8", "surrogatepass"))
                state[5] += chars
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if state is not None:
            yield row()

    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "start")
            .mapInArrow(run, schema))


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of all formatted conversations and of conversation -1."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)],
                                  "conv_id bigint, turn bigint, role string, text string")
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(read_back(format_chat(turns)))


def op4_sql() -> str:
    """The contract's digests from the turns themselves; lengths with every control string one sign longer."""
    rest = {c: "|".join(re.escape(x[1:]) for x in sorted(CONTROLS, key=len, reverse=True) if x[0] == c) for c in "<["}
    forms = "(<)(\\\\*(?:%s))|(\\[)(\\\\*(?:%s))" % (rest["<"], rest["["])
    escaped = "regexp_replace({}, '" + forms.replace("'", "''") + "', '\\1\\3\\\\\\2\\4', 'g')"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), conv AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{TRAINED_ROLE}'), '') AS loss,
    sum(length({escaped.format('role')}) + length({escaped.format('text')}) + {sum(map(len, MARKS.values()))}) AS chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  chars::BIGINT AS formatted_chars FROM conv
"""
