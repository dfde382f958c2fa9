"""Small tables and brute-force comparisons for the training-data tests."""
import os
import uuid

import numpy as np

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """Rows of (doc_id, text[, lang])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def folder(spark, tmp_path, **tables):
    """A folder of tables as the registered queries read it."""
    out = os.path.join(str(tmp_path), uuid.uuid4().hex)
    for name, df in tables.items():
        df.write.parquet(f"{out}/{name}.parquet")
    return out


def components(nodes, links):
    """Smallest node that each node reaches, by repeated relaxation."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{int(k)}" for k in rng.integers(0, vocabulary, n))


def rng(seed=0):
    return np.random.default_rng(seed)
