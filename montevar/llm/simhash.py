"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into four blocks of 16 bits; each of the four segments
leaves one block out (48 bits).  Two fingerprints at two or fewer differing bits differ by
at most one bit in at least one segment (the left-out block takes one of the two), so every link
is found by looking up the Hamming ball of radius one around each segment value in the table of
all segment values.  The ball is walked upwards only (a zero bit is set): of two
values at distance one, the smaller finds the larger, so each is met once.  Segments of 48 bits keep the
lists short even inside a large family of near copies, where 32-bit halves coincide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from montevar.llm import common
from montevar.llm.common import forget

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
_BLOCK = 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_OFFSETS = np.arange(8, dtype=np.intp) * 256


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of ``text`` (unsigned); zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()   # bytes: ASCII case and white space only
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start:start + (1 << 16)].view(np.uint8).reshape(-1, 8).astype(np.intp)
        part += _OFFSETS
        by_byte = np.bincount(part.ravel(), minlength=2048).reshape(8, 256)
        ones += (by_byte @ _BITS).ravel()
    set_bits = np.flatnonzero(2 * ones > len(hashes))
    return sum(1 << int(b) for b in set_bits)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every row; a null text counts as empty."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column("text")
            fps = [_signed(fingerprint(texts[i].as_py() or "", width)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp bigint")


def links(distinct_fps: DataFrame) -> DataFrame:
    """Pairs ``fp, other`` of different fingerprints at ``MAX_BITS`` or fewer differing bits."""
    masks = [((1 << 64) - 1) & ~(((1 << _BLOCK) - 1) << (_BLOCK * k)) for k in range(4)]
    rows = ", ".join(f"struct({k}Y AS seg, {_signed(m)}L AS mask)" for k, m in enumerate(masks))
    segments = distinct_fps.select("fp", F.explode(F.expr(f"array({rows})")).alias("s")).select(
        F.col("fp"), F.col("s.seg").alias("seg"), F.col("fp").bitwiseAND(F.col("s.mask")).alias("value"), "s.mask")
    flips = F.expr("array(0L, " + ", ".join(f"{_signed(1 << b)}L" for b in range(64)) + ")")
    probes = (segments.select("fp", "seg", "value", "mask", F.explode(flips).alias("flip"))
              .where((F.col("flip").bitwiseAND(F.col("mask")) == F.col("flip"))
                     & (F.col("flip").bitwiseAND(F.col("value")) == 0))
              .select("fp", F.col("seg").alias("p_seg"), F.col("value").bitwiseOR(F.col("flip")).alias("probe"),
                      (F.col("flip") == 0).alias("same")))
    found = segments.select(F.col("fp").alias("other"), "seg", "value")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= MAX_BITS
    # Size estimates do not see what explode adds, so the planner might broadcast either side: both are shuffled.
    return (probes.join(found.hint("merge"), (F.col("p_seg") == F.col("seg")) & (F.col("probe") == F.col("value"))
                        & near & (~F.col("same") | (F.col("fp") < F.col("other"))))
            .select("fp", "other").distinct())


def _classes(fps: DataFrame) -> DataFrame:
    """``node, root, component_id`` of every fingerprint of ``doc_id, fp``."""
    nodes = common.checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = common.connected_components(links(nodes.select("fp")))
    named = (nodes.join(roots, nodes.fp == roots.node, "left")
             .select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    named = common.checkpoint(named)
    first = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return named.join(first.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(
        F.col("fp").alias("node"), "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id reachable over links (fingerprints at two or
    fewer differing bits), the row itself included.  Equal fingerprints are one node, so groups
    of copies are never paired.  Null or empty texts have fingerprint zero and link like
    any other; a null id takes part but never names a component; repeated rows are
    returned as often as they occur; an empty table gives an empty result.  Other columns are ignored.
    """
    fps = common.materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = _classes(fps)
    return fps.join(classes, fps.fp == classes.node).select("doc_id", "fp", "component_id")


def op9(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component, the one with the smallest id.

    Rows without id come last; of rows with one id and different texts in a component the one whose text digest
    comes first stays.  Rows that repeat id and text are one document.
    """
    digest = F.coalesce(F.md5(F.encode("text", "utf-8")), F.lit("~"))
    # The digest travels in the place of the id, so fingerprints are made once.
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", digest.alias("digest")).alias("doc_id"), "text")
    with common.Scratch(spark) as own:
        fps = common.materialize(fingerprints(keyed), "simhash")
        named = _classes(fps.select("doc_id.doc_id", "fp"))
        keep = own.result(fps.join(named, F.col("fp") == F.col("node")).groupBy("root").agg(F.min("doc_id").alias("head"))
                          .select(F.col("head.doc_id").alias("__keep"), F.col("head.digest").alias("__digest")).distinct(), "simhash-kept")
    kept = docs.withColumn("__of", digest).join(
        keep, F.col("doc_id").eqNullSafe(F.col("__keep")) & (F.col("__of") == F.col("__digest")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__of"]).drop("__of")
