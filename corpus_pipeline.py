"""Corpus preparation: stages that run one after another over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and gives back the documents it keeps, with the columns of
``documents``; the last gives back packed pieces.  Between stages the documents are written to the shared
folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from montevar.llm import langid, packing, paragraphs, simhash, toxicity
from montevar.llm.common import materialize, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("language_id", langid.stage),
    ("simhash_near_dedup", simhash.stage),
    ("substring_dedup", paragraphs.stage),
    ("best_fit_packing", packing.stage),
]

#: The stages learn models and hash texts, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table: the packed pieces of what they keep.

    Null and empty texts go in the language stage, which knows no word of them; rows that repeat id and text, or
    whose texts are near copies, leave one document, whatever their ids (null ids come last); an empty table gives an
    empty result; columns beyond those of ``documents`` pass through to the packing, which drops them.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
