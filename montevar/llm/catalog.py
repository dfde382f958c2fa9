"""Registered queries of the subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from montevar.llm import (
    bitslice, chat, html_text, langid, licenses, packing, paragraphs, pq, runs, simhash, spiece, toxicity, trie)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pq_near_dedup": pq.op1,
        "op2_language_id": langid.op2,
        "op3_paragraph_dedup": paragraphs.op3,
        "op4_chat_format": chat.op4,
        "op5_toxicity": toxicity.op5,
        "op6_sentencepiece": spiece.op6,
        "op7_bit_sliced_top_k": bitslice.op7,
        "op8_html_main_text": html_text.op8,
        "op9_simhash_near_dedup": simhash.op9,
        "op10_best_fit_packing": packing.op10,
        "op11_prefix_trie": trie.op11,
        "op12_periodic_runs": runs.op12,
        "op13_license_scan": licenses.op13,
    }


def oracle_sql() -> dict[str, str]:
    """Brute force in SQL; the other queries are held against brute force, round trips and held-out rows in tests."""
    return {
        "op1_pq_near_dedup": pq.OP1_SQL,
        "op4_chat_format": chat.op4_sql(),
        "op7_bit_sliced_top_k": bitslice.OP7_SQL,
        "op11_prefix_trie": trie.op11_sql(),
    }
