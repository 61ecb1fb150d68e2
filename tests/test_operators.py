"""The DataFrame operators against the plain splitter and on their own cases."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from inkstone import errors
from inkstone.config import ImageConfig, SplitConfig
from inkstone.functions import text as T
from inkstone.operators import chunking as C
from inkstone.operators import images as I
from inkstone.operators import lines as L
from inkstone.operators import tables as B
from inkstone.operators import validate as V
from inkstone.plans import documents as D
from inkstone.plans import splitter as S
from inkstone.plans import tables as P
from inkstone.queries import QUERIES

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, md_content string, file_title string, md_path string"
PIECES = ["# A", "## B", "#### C ", "  ## D", "#x", "", "text。 two. three!", "```", "````", "~~~", "``` py", "![a](images/1.png)", "[l](u)", "| a | b |", "|---|---|", "| 1 | x\\|y |", "a b", "   ", "<table><tr><td>k</td><td>v</td></tr></table>"]


def corpus(n=120):
    rng = random.Random(5)
    return [(i, "\n".join(rng.choices(PIECES, k=rng.randrange(0, 30))), f"file{i}", f"/d/file{i}.md") for i in range(n)]


def test_sections_match_the_splitter(spark):
    docs = corpus()
    got = {(r.doc_id, r.section_idx): (r.heading_level, r.title, r.parent_title, tuple(r.heading_path), r.body) for r in L.sections(spark.createDataFrame(docs, DOCS)).collect()}
    want = {(d, s.index): (s.level, s.title, s.parent, s.path, s.body) for d, text, title, _ in docs for s in S.sections(text, title)}
    assert got == want


def test_blocks_match_the_splitter(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, 0, text) for d, text, *_ in docs], "doc_id long, section_idx int, body string")
    got = {(r.doc_id, r.block_no): (r.text, r.kind, r.atomic) for r in L.blocks(df).collect()}
    assert got == {(d, n): b for d, text, *_ in docs for n, b in enumerate(S.blocks(text))}


def test_splitting_does_not_shuffle(spark):
    plan = D.split(spark.createDataFrame(corpus(5), DOCS))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    assert "Exchange" not in L.sections(spark.createDataFrame(corpus(5), DOCS))._jdf.queryExecution().toString()


def test_packing_overlap_and_merging_match_the_splitter(spark):
    rng = random.Random(3)
    words = ["a", "bb. c!", "\n\n", "  ", "ddd。e", "f" * 30, "g" * 61, "h. i. j.", "\nk\n"]
    cases = []
    for n in range(150):
        pieces = [(rng.choice(words), rng.random() < 0.3) for _ in range(rng.randrange(0, 14))]
        drafts = [(rng.choice("xy"), rng.randrange(1, 60)) for _ in range(rng.randrange(0, 14))]
        cases.append((n, pieces, drafts))
    df = spark.createDataFrame(cases, "n int, pieces array<struct<text:string,atomic:boolean>>, drafts array<struct<key:string,length:int>>")
    packed = C.pack_pieces(F.col("pieces"), F.lit(40))
    out = df.select("n", packed.alias("packed"), C.sentence_overlap(packed, F.lit(40), 2).alias("over"), C.merge_short(F.col("drafts"), 30, 70).alias("groups")).collect()
    config = SplitConfig(70, 30, 0)
    for r in out:
        _, pieces, drafts = cases[r.n]
        want = S.packed(pieces, 40)
        assert r.packed == want and r.over == S.overlapped(want, 40, 2)
        parts = [S.Section(i, 1, "", "", (k,), "z" * size) for i, (k, size) in enumerate(drafts)]
        assert [list(range(g["first"], g["last"] + 1)) for g in r.groups] == [[p.index for p in g] for g in S.merged(parts, config)]


def test_pipe_tables_match_the_plain_version(spark):
    raws = ["| a | b |\n|---|---|\n| 1 | 2 |", "| k | v |\n| k2 |  |", "|  | a | b |\n| r | 1 |  |\n|  | 2 | 3 |", "| a |\n|:-:|", "| a | b | c |\n|---|---|\n| 1 |", "|  |  |\n|---|---|", "| a \\| b | c |\n| d | e |"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").withColumn("g", B.pipe_grid(F.col("raw")))
    df = df.select("i", "g", B.table_type(F.col("g.grid"), F.col("g.header")).alias("kind")).withColumn("text", B.sentences(F.col("g.grid"), F.col("kind")))
    for r in df.collect():
        grid, ruled = P.pipe_grid(raws[r.i].split("\n"))
        kind = P.table_type(grid, ruled)
        assert (r.g.grid, r.g.header, r.kind, r.text) == (grid, ruled, kind, P.sentences(grid, kind))


def test_long_pipe_tables_do_not_overflow(spark):
    text = "| a | b |\n" + "| 1 | 2 |\n" * 5000 + "x\n| solo |\n"
    out = B.pipe_tables(spark.createDataFrame([(1, text)], "doc_id long, md_content string")).collect()
    assert [(r.first_line, r.n_lines) for r in out] == [(0, 5001)]


def test_strip_and_paths(spark):
    values = [" a ", " \t　b\x1c", "", "/x/y.tar.gz", ".pdf", "/d/.hidden.md", "/d/a.", "n"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    from pathlib import PurePosixPath as Path

    for r in df.select("v", T.strip(F.col("v")).alias("s"), T.stem(F.col("v")).alias("stem"), T.suffix(F.col("v")).alias("suffix")).collect():
        assert r.s == r.v.strip()
        if r.v.startswith(("/", ".", "n")) and not r.v.endswith("a."):
            assert (r.stem, r.suffix) == (Path(r.v).stem, Path(r.v).suffix)


def test_documents_with_errors_are_set_apart(spark):
    rows = [(1, "# a\nx", "/d/a.md", None, None, None), (2, None, "/d/a.md", None, None, None), (3, "x", "/d/a.txt", None, None, None), (4, "", "/d/a.md", None, " t ", None), (5, "# " + "t" * 2001 + "\nbody", "/d/a.md", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, md_content string, md_path string, import_file_path string, file_title string, file_dir string")
    chunks, rejected = D.imported(df)
    assert {r.doc_id for r in chunks.collect()} == {1}
    assert {(r.doc_id, r.error_class) for r in rejected.collect()} == {(2, "FieldError"), (3, "FieldError"), (5, "SplitError")}
    with pytest.raises(Exception, match="FieldError"):
        errors.strict(V.checked_documents(df)).collect()


def test_files_of_both_kinds_become_chunks(spark):
    """The whole import with stand-ins for the services: order of stages, and every kind of failure beside good files."""
    paths = {1: "/in/a.pdf", 2: "/in/b.MD", 3: "/in/c.txt", 4: None, 5: "/in/broken.pdf", 6: "/in/lost.md", 7: " /in/d.markdown ", 8: "/in/wide.md"}
    files = spark.createDataFrame(list(paths.items()), "doc_id long, import_file_path string")
    contents = spark.createDataFrame([("/in/b.MD", "# B\ntext of b"), ("/in/d.markdown", "# D\n![old](images/p.png)\ntext of d"), ("/in/wide.md", "# " + "w" * 300 + "\nbody")], "md_path string, md_content string")

    def convert(pdfs):
        text = F.when(F.col("pdf_path") == "/in/a.pdf", "# A\n![old](images/p.png)\ntext of a")
        return pdfs.select("doc_id", text.alias("md_content"), F.when(text.isNull(), "PdfError").alias("error_class"), F.when(text.isNull(), "no PDF").alias("error_message"))

    images = spark.createDataFrame([(i, "p.PNG", "seen", f"http://s/{i}.png") for i in (1, 7)], "doc_id long, image_name string, summary string, url string")
    chunks, rejected = D.imported_files(files, contents, convert, lambda docs: I.rewritten(docs, images), SplitConfig(200, 50, 1))
    got = {r.doc_id: r for r in chunks.collect()}
    assert {i: r.content for i, r in got.items()} == {1: "# A\n\n![seen](http://s/1.png)\ntext of a", 2: "# B\n\ntext of b", 7: "# D\n\n![seen](http://s/7.png)\ntext of d"}
    assert (got[1].file_title, got[1].source_path, got[7].source_path) == ("a", "/in/a/auto/a.md", "/in/d.markdown")
    failed = {(r.doc_id, r.error_class, r.stage) for r in rejected.collect()}
    assert failed == {(3, "FieldError", "entry"), (4, "FieldError", "entry"), (5, "PdfError", "pdf"), (6, "FileError", "images"), (8, "SplitError", "split")}


def test_context_of_rows_with_one_id(spark):
    """Two rows of one doc_id are read each by itself; clashing columns stay as they are."""
    texts = ["# A\none\n\n![x](p.png)\n\ntwo\n# B\nthree", "four\n![y](q/p.png)\n\nfive"]
    docs = spark.createDataFrame([(1, t, "t", "p") for t in texts] + [(2, None, "t", "p")], DOCS)
    got = sorted((r.heading, r.pre_text, r.post_text) for r in I.contexts(docs, 200).collect())
    assert got == [("", "four", "five"), ("# A", "one", "two")]
    files = spark.createDataFrame([(1, "P.png", "kept", "of"), (1, "z.png", "kept", "of"), (None, "p.png", "k", "o")], "doc_id long, image_name string, key string, of string")
    refs = I.references(docs)
    assert [tuple(r) for r in I.referenced(files, refs).collect()] == [(1, "P.png", "kept", "of")]
    assert {r.image_name for r in I.unreferenced(files, refs).collect()} == {"z.png", "p.png"}
    odd = spark.createDataFrame([(1, "# a", "/d/a.md", None, None, None, "mine")], "doc_id long, md_content string, md_path string, import_file_path string, file_title string, file_dir string, found_title string")
    assert V.checked_documents(odd).first().found_title == "mine"


def test_image_stage(spark):
    text = "# H\nbefore\n\n![old](images/A%20b.png \"t\")\n\nafter\n![x](http://h/y.png)\n![z](images/none.png)"
    docs = spark.createDataFrame([(1, text, "Doc: 1", "/d/1.md")], DOCS)
    files = spark.createDataFrame([(1, "a b.PNG", "/d/images/a b.PNG", "data:..."), (1, "other.png", "/d/images/other.png", "data:...")], "doc_id long, image_name string, path string, data_url string")
    describe = lambda df: df.withColumn("summary", F.lit(' “a [nice]  view” '))
    store = lambda df: df.withColumn("url", F.col("object_url"))
    out = D.with_images(docs, files, describe, store, lambda df: df, ImageConfig(endpoint="h:9000", bucket="b")).first().md_content
    assert "![a nice view](http://h:9000/b/knowledge/Doc_%201/a%20b.PNG)" in out
    assert "![x](http://h/y.png)\n![z](images/none.png)" in out and "old" not in out
    context = I.contexts(docs, 200).filter("image_key = 'a b.png'").first()
    assert (context.heading, context.pre_text, context.post_text) == ("# H", "before", "after")


def test_failed_uploads_keep_the_reference(spark):
    docs = spark.createDataFrame([(1, "![a](x.png)", "t", "p.md")], DOCS)
    images = spark.createDataFrame([(1, "x.png", "s", "/local/x.png")], "doc_id long, image_name string, summary string, url string")
    assert I.rewritten(docs, images).first().md_content == "![a](x.png)"


def test_every_white_space_is_stripped(spark):
    texts = [chr(k) for k in range(1, 0x3100)] + ["᠎", "​", "﻿", "\U0001f600"]
    rows = spark.createDataFrame([(f"{x}a{x} b{x}",) for x in texts], "v string").select("v", T.strip(F.col("v")).alias("s")).collect()
    assert [r.s for r in rows] == [r.v.strip() for r in rows]


def test_time_is_linear_in_one_pipe_table(spark):
    """Each line is read once, however many there are, and not again for each line."""
    raw = "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 1500
    began = time.monotonic()
    (grid,) = spark.createDataFrame([(raw,)], "raw string").select(B.pipe_grid(F.col("raw")).alias("g")).collect()
    assert len(grid.g.grid) == 1501 and grid.g.header
    assert time.monotonic() - began < 15


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize(("name", "part", "most"), [("pipe_grid", r"(?<!\\)\|", 1), ("table_type", r"(?<!\\)\|", 1), ("table_fallback", "zip_with", 2)])
def test_plans_read_a_table_once(spark, name, part, most):
    """Lines are cut into cells at one place in the plan, and facts of each kind are made at one."""
    before = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    try:
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", before)
    assert 1 <= plan.count(part) <= most
