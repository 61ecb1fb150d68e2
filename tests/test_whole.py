"""Queries read whole texts, and long documents are no harder than many short ones."""

import os
import time

import pytest

from inkstone import inputs
from inkstone import queries as Q
from inkstone.operators import images as I
from inkstone.operators import lines as L
from inkstone.plans import splitter as S

DATA = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@with_tables
def test_overlap_reads_all_lines(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("text is not null").select("doc_id", "text").collect()
    assert max(r.text.count("\n") for r in docs) >= 12
    want = {(r.doc_id, n): t for r in docs for n, t in enumerate(S.overlapped(r.text.split("\n"), 400, 2))}
    assert {(r.doc_id, r.part_no): r.text for r in Q.QUERIES["sentence_overlap"](spark, DATA).collect()} == want


@with_tables
def test_markdown_keeps_all_text(spark):
    """Every character of a document but white space is in its Markdown, in order; so it is in the chunks."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert any(len(x) > 40 for t in docs.values() for x in t.split("\n"))
    got = {r.doc_id: r.md_content for r in inputs.markdown(spark, DATA).collect()}
    chunks: dict = {}
    for r in Q.QUERIES["chunks"](spark, DATA).orderBy("doc_id", "chunk_index").collect():
        chunks.setdefault(r.doc_id, []).append(r.content)
    for i, text in docs.items():
        for n, x in enumerate(text.split("\n")):
            if (i + 3 * n) % 8 == 1 and x.strip(" "):
                assert f"# {x[:40]}" + ("\n" + x[40:] if len(x) > 40 else "") in got[i]
            else:
                assert x in got[i]
    long = [(i, t[40:].strip()) for i, t in docs.items() if i % 8 == 1 and "\n" not in t and 40 < len(t) < 500]
    assert long and all(tail in "".join(chunks[i]) for i, tail in long)


@with_tables
def test_every_real_text_is_normalized(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id // 2: r.md_content for r in Q.QUERIES["normalize_text"](spark, DATA).collect() if r.doc_id % 2 == 0} == docs
    before = {r.doc_id: r.md_content for r in Q._state(spark, DATA).collect()}
    assert any((t or "").startswith("﻿") for t in before.values()) and any("\r" in (t or "") for t in before.values()) and None in before.values() and "" in before.values()
    sizes = {r.doc_id // 2: r.n_chars for r in Q.QUERIES["validate_docs"](spark, DATA).collect() if r.doc_id % 2 == 0}
    assert sizes == {i: len(t) for i, t in docs.items()}


@pytest.mark.parametrize("part", ["## head {n}\ntext {n}\n", "```\ncode {n}\n```\n", "![x](images/{n}.png)\nword {n}\n\n"])
def test_time_is_linear_in_one_document(spark, part):
    """Four times the text must not take anything like sixteen times as long."""
    took = []
    for n in (8000, 32000):
        docs = spark.createDataFrame([(1, "".join(part.format(n=k) for k in range(n)), "f")], "doc_id long, md_content string, file_title string").cache()
        docs.count()
        begin = time.monotonic()
        L.exploded(docs).count()
        L.blocks(L.sections(docs)).count()
        I.contexts(docs, 200).count()
        took.append(time.monotonic() - begin)
    assert took[1] < 8 * took[0] + 2, took


def test_lines_of_fences_side_by_side(spark):
    """Fences at both ends, next to each other, empty, unclosed, and with other markers inside."""
    texts = ["```\n```", "```\na\n```\n```\nb\n```", "\n```\n\n```\n", "a\n~~~\n```\n~~~~ \nb", "``` x`y\n```\n# in", "```\nopen", "", "\n", "    ```\nno", "~~~ a`b\nin\n~~~\n\n", "````\n```\n````\nout"]
    got: dict = {}
    for r in L.exploded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, md_content string")).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append((r.line, r.in_fence))
    for i, text in enumerate(texts):
        marker, want = "", []
        for line in text.split("\n"):
            was = marker
            marker = ("" if S.fence_closing(line, marker) else marker) if marker else S.fence_opening(line)
            want.append((line, bool(was or marker)))
        assert got[i] == want, text
