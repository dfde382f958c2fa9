"""Prefix trie of conversations by time-forward processing.

Every distinct sequence of first turns is a node.  A node is named by 128 bits: the exclusive or of
one hash for each turn of its sequence, keyed by the turn's position.  Such names are prefix
"sums", so a conversation that holds a third of all turns is named by many tasks.

Subtree totals move by time-forward processing.  Nodes are sorted externally in reverse level order; a
priority queue that spills to disk holds what children have sent, and a node takes its messages when its
time comes.  The tree is cut into shards of bounded size:

* by members: nodes with up to ``MEMBERS`` conversations, with up to ``MEMBERS`` squared, and so on. Members
  fall along every path, so each class is a forest, and the classes above the lowest have at most one
  node for ``MEMBERS`` turns;
* by depth: bands of ``LEVELS`` levels, so one endless conversation is many shards.

Totals are computed within the shards, then across the roots of those shards that have others
below them, and what comes from below is passed once more within these.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from montevar.llm.common import crc32_of, materialize, table

#: Largest number of members of a node of the lowest class; a class has nodes of up to that many times more.
MEMBERS = 4096
#: Levels of a band.
LEVELS = 1024
#: Copies of the rows of heavy nodes, met by the turns of all conversations through them.
SALTS = 64
#: Messages that a queue holds in memory.
HELD = 1 << 18
#: Conversation ids that are joined into one text before hashing.
CHUNK = 4096
#: Turns that a conversation may take over from the first of its group of five.
GROUP, HEAD = 5, 9


class SpillingQueue:
    """Smallest tuple first; beyond ``most`` tuples in memory, sorted runs go to unnamed files of the task."""

    def __init__(self, most: int = HELD, runs: int = 64):
        self.most, self.runs, self.heap, self.heads, self.count = most, runs, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self.heap.sort()
            self._keep(iter(self.heap))
            self.heap = []
            if len(self.heads) > self.runs:
                heads, self.heads = self.heads, []
                self._keep(heapq.merge(*(itertools.chain([first], rest) for first, _, rest in heads)))

    def _keep(self, items: Iterator[tuple]) -> None:
        file, block = tempfile.TemporaryFile(), []
        for item in items:
            block.append(item)
            if len(block) == 4096:
                pickle.dump(block, file)
                block = []
        if block:
            pickle.dump(block, file)
        file.seek(0)
        self._next(self._read(file))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, rest: Iterator[tuple]) -> None:
        first = next(rest, None)
        if first is not None:
            self.count += 1
            heapq.heappush(self.heads, (first, self.count, rest))

    def first(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] <= self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] <= self.heap[0]):
            first, _, rest = heapq.heappop(self.heads)
            self._next(rest)
            return first
        return heapq.heappop(self.heap)


def _mixed(lane: np.ndarray, position: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each (lane, position)."""
    with np.errstate(over="ignore"):
        # Multipliers of the splitmix64 generator.
        x = lane ^ ((position.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


def _starts(conv: np.ndarray, last: int | None) -> np.ndarray:
    """Whether each row begins a conversation, given the one before the first row."""
    new = np.ones(len(conv), dtype=bool)
    new[1:] = conv[1:] != conv[:-1]
    new[0] = last is None or conv[0] != last
    return new


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, n_bytes``: the turns of each conversation, numbered from 0.

    Turns come by ``turn``, null first, ties by role and text; null roles and texts are empty; repeated
    rows stay; rows without ``conv_id`` belong to no conversation and are left out.  Conversations are named by
    whole numbers.  ``digest`` is the MD5 of role and text, ``n_bytes`` the text's length in UTF-8.  Other
    columns are ignored; an empty table gives no rows.

    Turns are cut by ranges, so the numbers are ranks within a task plus the turns of the tasks before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    src = (turns.where("conv_id IS NOT NULL")
           .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
           .withColumn("digest", F.unhex(F.md5(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8"))))
           .withColumn("n_bytes", F.octet_length("text").cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            new, row = _starts(conv, last), np.arange(batch.num_rows)
            begin = np.maximum.accumulate(np.where(new, row, -1))
            rank = np.where(begin >= 0, row - begin, row + at)
            last, at = int(conv[-1]), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(np.full(len(conv), part, dtype=np.int32)), pa.array(rank.astype(np.int64)),
                 batch.column("digest"), batch.column("n_bytes")], ["conv_id", "part", "at", "digest", "n_bytes"])

    order = ["conv_id", "turn", "role", "text"]
    # Ranges are told apart by the beginnings of role and text, in the same order: the bounds are sampled on the driver.
    begins = (F.substring("role", 1, 64), F.asc_nulls_last(F.when(F.length("role") <= 64, F.substring("text", 1, 64))))
    ranked = materialize(src.repartitionByRange("conv_id", "turn", *begins).sortWithinPartitions(*order).drop("turn", "role", "text")
                         .mapInArrow(run, "conv_id bigint, part int, at bigint, digest binary, n_bytes bigint"), "trie-turns")
    before = _before(ranked, n=("count(1)", "sum"))
    return (ranked.join(before, (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")), "left")
            .select("conv_id", (F.col("at") + F.coalesce("n", F.lit(0))).alias("pos"), "digest", "n_bytes"))


def _before(rows: DataFrame, **aggregates: tuple[str, str]) -> DataFrame:
    """``c, p`` and the aggregates over the tasks before task ``p`` that hold turns of conversation ``c``, if any do.

    An aggregate is that of a task's rows and the one that joins tasks.  The result is small: at most one
    row for each border between tasks.
    """
    held = rows.groupBy("conv_id", "part").agg(*(F.expr(of).alias(name) for name, (of, _) in aggregates.items()))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    joined = [F.expr(f"{over}({name})").over(earlier).alias(name) for name, (_, over) in aggregates.items()]
    return (held.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), *joined)
            .where(F.col(next(iter(aggregates))).isNotNull()))


def _paths(seq: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, hi, lo, up_hi, up_lo, n_bytes``: the nodes on the path of each conversation, root included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, before = TaskContext.get().partitionId(), None, np.zeros(2, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, pos = (batch.column(c).to_numpy() for c in ("conv_id", "pos"))
            lanes = np.frombuffer(b"".join(batch.column("digest").to_pylist()), dtype="<u8").reshape(-1, 2)
            new, row = _starts(conv, last), np.arange(batch.num_rows)
            begin = np.maximum.accumulate(np.where(new, row, -1))
            columns, end = [], before.copy()
            for k in range(2):
                own = _mixed(lanes[:, k], pos, k)
                total = np.bitwise_xor.accumulate(own)
                # What was summed up before the conversation began is taken out again; one that goes on is added to.
                base = np.where(begin > 0, total[begin - 1], np.where(begin < 0, before[k], np.uint64(0)))
                name = total ^ base
                columns += [name, own]
                end[k] = name[-1]
            last, before = int(conv[-1]), end
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("pos"), pa.array(np.full(len(conv), part, dtype=np.int32)),
                 *(pa.array(c.view(np.int64)) for c in columns), batch.column("n_bytes")],
                ["conv_id", "pos", "part", "hi", "own_hi", "lo", "own_lo", "n_bytes"])

    named = materialize(
        seq.repartitionByRange("conv_id", "pos").sortWithinPartitions("conv_id", "pos").mapInArrow(
            run, "conv_id bigint, pos bigint, part int, hi bigint, own_hi bigint, lo bigint, own_lo bigint, n_bytes bigint"), "trie-names")
    before = _before(named, b_hi=("bit_xor(own_hi)", "bit_xor"), b_lo=("bit_xor(own_lo)", "bit_xor"))
    full = (named.join(before, (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")), "left")
            .withColumn("hi", F.col("hi").bitwiseXOR(F.coalesce("b_hi", F.lit(0))))
            .withColumn("lo", F.col("lo").bitwiseXOR(F.coalesce("b_lo", F.lit(0)))))
    turns = full.select("conv_id", (F.col("pos") + 1).alias("depth"), "hi", "lo",
                        F.col("hi").bitwiseXOR(F.col("own_hi")).alias("up_hi"),
                        F.col("lo").bitwiseXOR(F.col("own_lo")).alias("up_lo"), "n_bytes")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), none.alias("up_hi"),
                         none.alias("up_lo"), zero.alias("n_bytes"))
    return turns.unionByName(roots)


def _class(n: Column, members: int) -> Column:
    """How many powers of ``members`` are below ``n``."""
    found, power = F.lit(0), members
    while power < 1 << 62:
        found, power = found + (n > power).cast("int"), power * members
    return found


def _forward(rows: DataFrame, one_shard: bool = False) -> DataFrame:
    """Sum ``kids, leaves, saved`` over the subtrees of each shard.

    ``rows`` are nodes (``is_node``) and messages from outside to them, with their shard (``s_hi, s_lo``) and ``depth, hi, lo``
    and, for nodes that pass on their totals within the shard, the parent's ``up_depth, up_hi, up_lo``.  Null ``leaves`` of a node
    stand for one if nothing comes to it.  Gives back the nodes with their totals; other columns are carried along.
    """
    fields = rows.drop("is_node").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, outside = SpillingQueue(), [0, 0, 0]
        for batch in batches:
            names = ("is_node", "depth", "hi", "lo", "up_depth", "up_hi", "up_lo", "kids", "leaves", "saved")
            out, at = [], []
            for i, (is_node, depth, hi, lo, up_depth, up_hi, up_lo, kids, leaves, saved) in enumerate(
                    zip(*(batch.column(c).to_pylist() for c in names))):
                if not is_node:                                  # messages stand right before their node
                    outside = [outside[0] + kids, outside[1] + leaves, outside[2] + saved]
                    continue
                got_kids, got_leaves, got_saved = outside
                outside = [0, 0, 0]
                me = (-depth, hi, lo)
                while (first := queue.first()) is not None and first[:3] == me:
                    _, _, _, k, n, s = queue.pop()
                    got_kids, got_leaves, got_saved = got_kids + k, got_leaves + n, got_saved + s
                if leaves is None:
                    leaves = 0 if got_kids else 1
                total = (kids + got_kids, leaves + got_leaves, saved + got_saved)
                if up_hi is not None:
                    queue.push((-up_depth, up_hi, up_lo, 1, *total[1:]))
                out.append(total)
                at.append(i)
            if at:
                kept = batch.take(pa.array(at))
                sums = dict(zip(("kids", "leaves", "saved"), zip(*out)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sums[c], pa.int64()) if c in sums else kept.column(c) for c in fields], fields)

    # Only what meets in the one shard goes to one task, not the work that finds it.
    dealt = rows.repartition(1) if one_shard else rows.repartition("s_hi", "s_lo")
    return (dealt.sortWithinPartitions(F.desc("depth"), "hi", "lo", "is_node")
            .mapInArrow(run, ", ".join(f"{c} bigint" for c in fields)))


def _ends(paths: DataFrame) -> DataFrame:
    """``hi, lo, n_ends, ends_sha256`` of the nodes at which conversations end.

    A hash reads the ids of a node in order.  Ranges of ids are joined into texts by many tasks first; the
    task that hashes a node reads these, one batch at a time.
    """
    last = (paths.groupBy("conv_id").agg(F.max(F.struct("depth", "hi", "lo")).alias("end"))
            .select(F.col("end.hi").alias("hi"), F.col("end.lo").alias("lo"), "conv_id"))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, conv = (batch.column(c).to_numpy() for c in ("hi", "lo", "conv_id"))
            new = np.ones(len(hi), dtype=bool)
            new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            cut = np.flatnonzero(new)
            cut = np.unique(np.concatenate([cut, np.arange(0, len(hi), CHUNK)]))
            ids, ends = conv.tolist(), [*cut[1:].tolist(), len(hi)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hi[cut]), pa.array(lo[cut]), pa.array(conv[cut]), pa.array(np.diff([*cut, len(hi)]).astype(np.int64)),
                 pa.array([",".join(map(str, ids[a:b])) for a, b in zip(cut.tolist(), ends)])],
                ["hi", "lo", "conv_id", "n", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, n = None, None, 0
        for batch in batches:
            out = []
            for hi, lo, count, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "n", "ids"))):
                if node == (hi, lo):
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, n, state.hexdigest()))
                    node, state, n = (hi, lo), hashlib.sha256(), 0
                state.update(ids.encode())
                n += count
            if out:
                yield rows(out)
        if node is not None:
            yield rows([(*node, n, state.hexdigest())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                          ["hi", "lo", "n_ends", "ends_sha256"])

    chunks = (last.repartitionByRange("hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id")
              .mapInArrow(chunk, "hi bigint, lo bigint, conv_id bigint, n bigint, ids string"))
    return (chunks.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "conv_id")
            .mapInArrow(digest, "hi bigint, lo bigint, n_ends bigint, ends_sha256 string"))


def trie(seq: DataFrame, convs: DataFrame, members: int = MEMBERS, levels: int = LEVELS) -> DataFrame:
    """The prefix trie of ``seq`` (as ``sequences`` gives it); ``convs`` names all conversations, also turnless ones.

    One row per node: ``node, parent`` (names, 32 hex digits; the root's parent is null), ``conv_id`` (smallest member),
    ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256``.  Without any
    conversation there are no rows.  ``members`` and ``levels`` bound a shard; the rows do not depend on them.
    """
    paths = materialize(_paths(seq, convs), "trie-paths")
    counted = materialize(
        paths.groupBy("hi", "lo").agg(F.min("depth").alias("depth"), F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"),
                                      F.min("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
        .withColumn("class", _class(F.col("n_convs"), members)), "trie-counts")

    # The cell (class and band) of each turn, and the first node of each cell on each path.
    heavy = (counted.where("class > 0").select(F.col("hi").alias("h_hi"), F.col("lo").alias("h_lo"), F.col("class").alias("h_class"))
             .withColumn("h_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    band = F.floor(F.col("depth") / levels).cast("long")
    placed = (paths.withColumn("salt", salt)
              .join(heavy, (F.col("hi") == F.col("h_hi")) & (F.col("lo") == F.col("h_lo")) & (F.col("salt") == F.col("h_salt")), "left")
              .select("conv_id", F.coalesce("h_class", F.lit(0)).alias("class"), band.alias("band"), "depth", "hi", "lo"))
    cells = (placed.groupBy("conv_id", "class", "band").agg(F.min(F.struct("depth", "hi", "lo")).alias("top"))
             .withColumn("above", F.lag("top").over(Window.partitionBy("conv_id").orderBy("top.depth")))
             .select(F.col("conv_id").alias("c"), F.col("class").alias("k"), F.col("band").alias("b"), "top", "above"))
    in_shard = ~((F.col("hi") == F.col("top.hi")) & (F.col("lo") == F.col("top.lo")))
    nodes = materialize(
        counted.withColumn("band", band)
        .join(cells, (F.col("conv_id") == F.col("c")) & (F.col("class") == F.col("k")) & (F.col("band") == F.col("b")))
        .select("hi", "lo", "depth", F.col("up_hi").alias("p_hi"), F.col("up_lo").alias("p_lo"), "n_convs", "conv_id",
                F.col("top.hi").alias("s_hi"), F.col("top.lo").alias("s_lo"),
                F.when(in_shard, F.col("depth") - 1).alias("up_depth"), F.when(in_shard, F.col("up_hi")).alias("up_hi"),
                F.when(in_shard, F.col("up_lo")).alias("up_lo"),
                # Only shard roots say which shard their parent is in.
                *(F.when(~in_shard, F.col(f"above.{c}")).alias(f"a_{c}") for c in ("depth", "hi", "lo")),
                ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), "trie-nodes")

    zero = F.lit(0).cast("long")
    carried = ["n_convs", "conv_id", "p_hi", "p_lo", "a_depth", "a_hi", "a_lo"]
    place = ["s_hi", "s_lo", "depth", "hi", "lo", "up_depth", "up_hi", "up_lo"]

    def messages(of: DataFrame, leaves: Column, saved: Column) -> DataFrame:
        """What the shard roots ``of`` send to their parents in other shards, one row for each parent."""
        return (of.where("a_hi IS NOT NULL").groupBy(F.col("a_hi").alias("s_hi"), F.col("a_lo").alias("s_lo"), F.col("p_hi").alias("hi"),
                                                     F.col("p_lo").alias("lo"), (F.col("depth") - 1).alias("depth"))
                .agg(F.count(F.lit(1)).alias("kids"), F.sum(leaves).alias("leaves"), F.sum(saved).alias("saved"))
                .withColumn("is_node", F.lit(False)))

    def to_shards(of: DataFrame) -> DataFrame:
        """What they send to these shards as a whole, one row for each."""
        return (of.where("a_hi IS NOT NULL").groupBy(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo"), F.col("a_depth").alias("depth"))
                .agg(F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
                .select("*", zero.alias("s_hi"), zero.alias("s_lo"), F.lit(False).alias("is_node")))

    def stream(rows: DataFrame, sent: DataFrame) -> DataFrame:
        return rows.withColumn("is_node", F.lit(True)).unionByName(sent, allowMissingColumns=True)

    # Within the shards.  Parents of other shards' roots only learn that they have children.
    hooks = messages(nodes, zero, zero)
    within = materialize(_forward(stream(
        nodes.select(*place, *carried, zero.alias("kids"), F.lit(None).cast("long").alias("leaves"), "saved"), hooks)), "trie-within")
    roots = within.where("hi = s_hi AND lo = s_lo")

    # Across the roots of the shards that others hang from.
    inner = roots.where("a_hi IS NOT NULL").select(F.col("a_hi").alias("i_hi"), F.col("a_lo").alias("i_lo")).distinct()
    mine = (F.col("s_hi") == F.col("i_hi")) & (F.col("s_lo") == F.col("i_lo"))
    outer = roots.join(inner, mine, "left_anti")
    above = roots.join(inner, mine, "left_semi").select(
        zero.alias("s_hi"), zero.alias("s_lo"), "depth", "hi", "lo",
        *(F.col(f"a_{c}").alias(f"up_{c}") for c in ("depth", "hi", "lo")), *carried, "kids", "leaves", "saved")
    across = materialize(_forward(stream(above, to_shards(outer)), one_shard=True), "trie-across")

    # Once more within those shards: totals from below are passed on.
    whole = outer.select(*place, *carried, "kids", "leaves", "saved").unionByName(across.select(*place, *carried, "kids", "leaves", "saved"))
    late = messages(whole, F.col("leaves"), F.col("saved")).withColumn("kids", zero)
    again = within.join(inner, mine, "left_semi").select(
        *place, *carried, F.col("kids").alias("w_kids"), F.col("leaves").alias("w_leaves"), F.col("saved").alias("w_saved"),
        zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"))
    passed = _forward(stream(again, late)).select(
        "hi", "lo", "depth", *carried, F.col("w_kids").alias("kids"),
        *((F.col(f"w_{c}") + F.col(c)).alias(c) for c in ("leaves", "saved")))
    done = within.join(inner, mine, "left_anti").select("hi", "lo", "depth", *carried, "kids", "leaves", "saved").unionByName(passed)

    ends = _ends(paths).select(F.col("hi").alias("e_hi"), F.col("lo").alias("e_lo"), "n_ends", "ends_sha256")
    parents = counted.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), F.col("conv_id").alias("parent_conv_id"))
    name = lambda hi, lo: F.concat(*(F.lpad(F.lower(F.hex(c)), 16, "0") for c in (hi, lo)))
    return (done.join(parents, (F.col("p_hi") == F.col("q_hi")) & (F.col("p_lo") == F.col("q_lo")), "left")
            .join(ends, (F.col("hi") == F.col("e_hi")) & (F.col("lo") == F.col("e_lo")), "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"),
                    F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
                    F.coalesce("n_ends", zero).alias("n_ends"), name("hi", "lo").alias("node"), name("p_hi", "p_lo").alias("parent")))


def prefix_trie(turns: DataFrame, members: int = MEMBERS, levels: int = LEVELS) -> DataFrame:
    """The prefix trie of the conversations of ``turns`` (``conv_id, turn, role, text``); see ``sequences`` and ``trie``."""
    seq = sequences(turns)
    return trie(seq, seq.select("conv_id").distinct(), members, levels)


def rebuilt(seq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences and conversations after the contract's rebuilding.

    A conversation takes the first h turns of the first conversation of its group (of all five ids, whether or
    not it is there) and then its own turns after its first h; h is the CRC-32 of its id modulo nine.
    """
    convs = seq.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = crc32_of(F.col("conv_id")) % HEAD
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    known = convs.select(F.col("conv_id").alias("b"), F.col("n").alias("b_n"))
    plan = materialize(
        convs.withColumn("h", h).withColumn("base", base).join(known, F.col("base") == F.col("b"), "left")
        .select("conv_id", "base", "h", F.least("h", F.coalesce("b_n", F.lit(0))).alias("taken")), "trie-plan")
    own = (seq.join(plan.select(F.col("conv_id").alias("c"), "h", "taken"), F.col("conv_id") == F.col("c"))
           .where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n_bytes"))
    head = (seq.where(F.col("pos") < HEAD - 1).withColumnRenamed("conv_id", "from")
            .join(plan.select("conv_id", "base", "h"), F.col("from") == F.col("base"))
            .where("pos < h").select("conv_id", "pos", "digest", "n_bytes"))
    return head.unionByName(own), plan.select("conv_id")


def op11(spark, sf_dir: str) -> DataFrame:
    """Contract query: the prefix trie of all rebuilt conversations."""
    out = trie(*rebuilt(sequences(table(spark, sf_dir, "conversations"))))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_sql() -> str:
    """The contract by whole sequences: nodes are their texts, subtrees all nodes that start with them."""
    # CRC-32 of the decimal id, bit by bit.
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(conv_id::VARCHAR)),
        lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END::BIGINT)),
        lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))))"""
    return f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {crc} % {HEAD} AS h FROM (SELECT DISTINCT conv_id FROM t)
), turns AS (
  SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h
), steps AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS path FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
), paths AS (
  SELECT conv_id, depth, bytes, path, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up FROM steps
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs
), lasts AS (
  SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id
), nodes AS (
  SELECT path, any_value(up) AS up, min(p.conv_id) AS conv_id, any_value(p.depth) AS depth, count(*) AS n_convs,
    any_value(bytes) AS bytes, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (p.depth = l.depth) AS ends
  FROM paths p JOIN lasts l ON p.conv_id = l.conv_id GROUP BY path
), kids AS (
  SELECT up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up
), sums AS (
  SELECT a.path, sum((d.n_convs - 1) * d.bytes) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes a JOIN nodes d ON starts_with(d.path, a.path) LEFT JOIN kids k ON k.up = d.path GROUP BY a.path
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  coalesce(k.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
  sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN kids k ON k.up = n.path LEFT JOIN nodes u ON u.path = n.up AND n.depth > 0
"""
