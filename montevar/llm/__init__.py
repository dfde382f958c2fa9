"""Operators for preparing training data: near-duplicates, language, toxicity, packing and so on.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""
