"""The corpus pipeline and its registration: planted cases, columns, copies, edge rows."""
import os
import subprocess
import sys

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from montevar.llm import catalog, simhash
from tests.llm.helpers import documents, folder, prose, rng

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.01"


def test_planted_cases(spark, tmp_path):
    r = rng(1)
    passage = prose(r, 60)
    rows = [(k, prose(r, 80)) for k in range(200)]
    rows += [(300 + k, f"{prose(r, 30)} you idiot scum {prose(r, 30)}") for k in range(40)]
    rows += [(400 + k, rows[5][1]) for k in range(30)]                       # copies of document 5
    rows += [(500 + k, f"{prose(r, 30)}\n{passage}\n{prose(r, 30)}") for k in range(10)]
    rows += [(600, "12345 !!"), (601, None), (602, "")]
    sf = folder(spark, tmp_path, documents=documents(spark, rows), labels=spark.createDataFrame(
        [(i, 1, int(300 <= i < 340)) for i, _ in rows if i < 340], "doc_id bigint, quality int, toxic int"))
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = corpus_pipeline.materialize(out, name)
        seen[name] = {x.doc_id: x.text for x in docs.collect()}
    ids = [set(v) for v in seen.values()]
    assert ids[0] == {i for i, _ in rows} - set(range(300, 340))
    assert ids[1] == ids[0] - {600, 601, 602}
    assert ids[2] == ids[1] - set(range(400, 430))
    assert ids[3] == ids[2]
    last = seen["substring_dedup"]
    assert [i for i in range(500, 510) if passage in last[i]] == [500]
    assert all(last[i] == t for i, t in rows if i < 200)
    assert {x.doc_id for x in corpus_pipeline.run(spark, sf).collect()} == ids[3]


def test_run_over_the_given_tables(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"]).to_pandas()
    assert set(out.doc_id) < set(docs.doc_id) and len(set(out.doc_id)) > 700
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()
    fps = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(fps[i] in fps for i in set(out.doc_id))


def test_an_empty_corpus(spark, tmp_path):
    sf = folder(spark, tmp_path, documents=documents(spark, []), labels=spark.createDataFrame(
        [], "doc_id bigint, quality int, toxic int"))
    assert corpus_pipeline.run(spark, sf).count() == 0


@pytest.mark.parametrize("name", catalog.queries())
def test_queries_of_empty_tables(spark, tmp_path, name):
    schemas = {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
               "labels": "doc_id bigint, quality int, toxic int", "embeddings": "vec_id bigint, embedding array<float>, label int",
               "pages": "page_id bigint, url string, html string",
               "conversations": "conv_id bigint, turn bigint, role string, text string"}
    sf = folder(spark, tmp_path, **{k: spark.createDataFrame([], v) for k, v in schemas.items()})
    rows = catalog.queries()[name](spark, sf).count()
    assert rows == (1 if name.startswith("op4_") else 0)             # conversation -1 is always there


def test_names_and_rows(spark):
    assert [n.split("_")[0] for n in catalog.queries()] == [f"op{k}" for k in range(1, 14)]
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_the_rest_imports_without_the_subpackage(tmp_path):
    """As when the subpackage, its tests and the pipeline are deleted."""
    subprocess.run(["cp", "-r", f"{REPO}/montevar", f"{REPO}/__spark_entry__.py", str(tmp_path)], check=True)
    (tmp_path / "montevar/llm/__init__.py").write_text("raise ImportError\n")
    code = ("import __spark_entry__ as e; q = e.queries(); assert 'value_at_risk' in q; "
            "assert not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
