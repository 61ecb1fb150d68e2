"""The functions in SQL against the same as DataFrames."""

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from inkstone import sql
from inkstone.config import SplitConfig
from inkstone.operators import chunking as C
from inkstone.operators import lines as L
from inkstone.operators import tables as B
from inkstone.plans.documents import split

TEXTS = ["# A\nwords\n\n## B\n```\n# no\n```\n![x](y.png)\nmore. Words!\n", "before\n# A\n| a | b |\n|---|---|\n| 1 | 2 |\n", "", None, "<table><tr><th>h</th><td>i</td></tr><tr><td colspan=2>x</td></tr></table>", "long words, and so on. " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    sql.register(spark)
    rows = [(i, t, f"t{i}", f"/in/t{i}.md", "other") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, md_content string, file_title string, md_path string, body string")
    df.createOrReplaceTempView("sql_docs")
    return df


def same(a, b):
    assert a.columns == b.columns and a.dtypes == b.dtypes
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_lateral(spark, docs):
    found = L.sections(docs)
    same(spark.sql("SELECT doc_id, s.* FROM sql_docs, LATERAL sections(md_content, file_title) s"), found)
    same(spark.sql("SELECT doc_id, section_idx, b.* FROM sql_docs d, LATERAL sections(d.md_content, d.file_title) s, LATERAL blocks(s.body) b"), L.blocks(found))
    pieces = docs.select("doc_id", F.posexplode(C.recursive_split("md_content", F.lit(30))).alias("piece_no", "piece"))
    same(spark.sql("SELECT doc_id, p.* FROM sql_docs, LATERAL recursive_split(md_content, 30) p"), pieces)
    same(spark.sql("SELECT doc_id, s.* FROM sql_docs, LATERAL text_sentences(md_content) s"), docs.select("doc_id", F.posexplode(C.sentences(F.col("md_content"))).alias("sentence_no", "sentence")))


def test_scalars_and_cells(spark, docs):
    same(spark.sql("SELECT doc_id, linearized(md_content) AS t FROM sql_docs"), docs.select("doc_id", B.linearized("md_content").alias("t")))
    cells = spark.sql("SELECT doc_id, c.* FROM sql_docs, LATERAL table_cells(md_content) c WHERE doc_id = 4 ORDER BY row_no, column_no").collect()
    assert [tuple(r) for r in cells] == [(4, 0, 0, "h", "header_table"), (4, 0, 1, "i", "header_table"), (4, 1, 0, "x", "header_table"), (4, 1, 1, "x", "header_table")]
    around = spark.sql("SELECT doc_id, c.* FROM sql_docs, LATERAL line_contexts(md_content, array(7), 200) c WHERE doc_id = 0").collect()
    assert [tuple(r) for r in around] == [(0, 7, "# no", "```", "more. Words!")] * 2


def test_chunks_by_partition(spark, docs):
    got = spark.sql("SELECT * FROM chunks(TABLE(sql_docs) PARTITION BY doc_id, max_length => 60, min_length => 20, overlap => 1)")
    same(got.filter("error_class is null").drop("error_class", "error_message"), split(docs, SplitConfig(60, 20, 1)))
    none = spark.sql("SELECT * FROM chunks(TABLE(SELECT * FROM sql_docs WHERE false) PARTITION BY (doc_id), 60, 20, 1)")
    assert none.count() == 0
    spark.sql("SELECT 1L AS doc_id, '# ' || repeat('t', 80) || chr(10) || repeat('w ', 60) AS md_content, 'f' AS file_title, 'p' AS md_path").createOrReplaceTempView("sql_tight")
    assert [r.error_class for r in spark.sql("SELECT * FROM chunks(TABLE(sql_tight) PARTITION BY (doc_id), 60, 20, 1)").collect()] == ["SplitError"]


@pytest.mark.parametrize(
    "call",
    ["blocks(7)", "recursive_split('a', 'b')", "recursive_split('a', 0)", "chunks(TABLE(SELECT 1 AS doc_id) PARTITION BY (doc_id), 60, 20, 1)", "chunks(TABLE(sql_docs) PARTITION BY (doc_id), 20, 60, 1)", "sections(TABLE(sql_docs), 'x')"],
)
def test_bad_calls_fail_before_any_job(spark, docs, call):
    with pytest.raises((AnalysisException, PySparkException)):
        spark.sql(f"SELECT * FROM {call}")
