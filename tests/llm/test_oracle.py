"""Registered queries against their SQL in DuckDB over the given tables."""
import duckdb
import pytest

from montevar.llm import catalog, common, paragraphs
from montevar.llm.paragraphs import MIN_WORDS, SHINGLE_WORDS, SIMILARITY

SF = "/root/testdata/sf0.01"

#: Similar lines and their components by brute force; the passages of op3 are picked by hashes that SQL does not have.
LINES_SQL = f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, line, t, (sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(t) - 1)::BIGINT AS start,
    list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> '') AS w FROM lines
), p AS (
  SELECT row_number() OVER (ORDER BY doc_id, line) AS id, * FROM placed WHERE len(w) >= {MIN_WORDS}
), shingle AS (
  SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - {SHINGLE_WORDS} + 2),
    lambda i: array_to_string(w[i:i + {SHINGLE_WORDS} - 1], ' '))) AS s FROM p
), n AS (SELECT id, count(*) AS k FROM shingle GROUP BY id),
overlap AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM overlap JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE overlap.k >= {SIMILARITY} * (a.k + b.k - overlap.k)
), reach AS (
  SELECT id, id AS root FROM p
  UNION
  SELECT link.y, reach.root FROM reach JOIN link ON reach.id = link.x
), low AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
shared AS (SELECT root FROM low GROUP BY root HAVING count(*) > 1)
SELECT p.doc_id, p.line::INTEGER AS line, p.start, length(p.t)::BIGINT AS n_chars, h.doc_id AS component_doc,
  h.line::INTEGER AS component_line, p.id <> h.id AS removed
FROM p JOIN low USING (id) JOIN shared USING (root) JOIN p h ON h.id = low.root
"""



@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    df = catalog.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, result.fetchall()))


def test_similar_lines_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    result = con.execute(LINES_SQL)
    names = [d[0] for d in result.description]
    df = paragraphs.repeats(common.table(spark, SF, "documents"))
    got = sorted(str(tuple(r)) for r in df.select(*names).collect())
    assert got == sorted(map(str, result.fetchall()))
    # The query has these rows, and passages beside them.
    rows = catalog.queries()["op3_paragraph_dedup"](spark, SF)
    assert sorted(str(tuple(r)) for r in rows.where("kind = 'paragraph'").select(*names).collect()) == got
