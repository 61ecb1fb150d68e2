"""Lines, fences, headings, sections and blocks of Markdown, each document within its row.

Lines and fences are found by splitting the text at whole fences; nothing is folded, and every step is linear in the
text. Heading paths and blocks are ordered folds, so they are one Arrow pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import splitter

# Formats of the input.
FENCE = r"(?d)\A {0,3}(`{3,}|~{3,})(.*)\z"
HEADING = r"(?d)\A {0,3}(#{1,6})[ \t]+(.+?)[ \t]*\z"
#: A whole fence: its opening line, and all up to a line with nothing but as long a marker, or up to the end.
WHOLE_FENCE = r"(?dmU)^ {0,3}(?:(`{3,}+)[^`\n]*|(~{3,}+)[^\n]*)$(?:[\u0000-\x{10FFFF}]*?\n {0,3}(?:\1`*+|\2~*+)[\s\x1c-\x1f&&[^\n]]*$|[\u0000-\x{10FFFF}]*\z)"

LINE = "array<struct<line:string,in_fence:boolean>>"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def marker(line: Column) -> Column:
    """The fence marker that a line begins with, opening or closing; ''."""
    return F.regexp_extract(line, FENCE, 1)


def opens(line: Column) -> Column:
    """Whether a line can open a fence: a backtick fence's info has no backtick."""
    m = marker(line)
    return (m != "") & ~(m.startswith("`") & F.regexp_extract(line, FENCE, 2).contains("`"))


def fenced_lines(text: Column) -> Column:
    """array<struct<line, in_fence>> of a text: a fence's opening and closing lines are inside it; one that isn't closed runs to the end."""
    pieces = F.arrays_zip(F.split(text, WHOLE_FENCE, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WHOLE_FENCE), F.lit(0)).alias("fence"))
    flagged = lambda xs, inside: F.transform(xs, lambda x: F.struct(x.alias("line"), F.lit(inside).alias("in_fence"))).cast(LINE)
    nothing = F.array().cast(LINE)

    def piece(z: Column, i: Column) -> Column:
        # the line ends beside a fence belong to neither side
        before, after = (i > 0).cast("int"), z["fence"].isNotNull().cast("int")
        empty = F.length(z["gap"]) == F.when(before + after == 2, 1).when(before + after == 1, 0).otherwise(-1)
        inner = F.substring(z["gap"], before + 1, F.length(z["gap"]) - before - after)
        gap = F.when(empty, nothing).otherwise(flagged(lines(inner), False))
        return F.concat(gap, F.when(z["fence"].isNull(), nothing).otherwise(flagged(lines(z["fence"]), True)))

    return F.flatten(F.transform(pieces, piece))


def heading_level(line: Column) -> Column:
    """1 to 6 for an ATX heading with a text, else 0."""
    real = T.strip(F.regexp_extract(line, HEADING, 2)) != ""
    return F.when(real, F.length(F.regexp_extract(line, HEADING, 1))).otherwise(0)


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, in_fence, heading_level: a row per line of docs (doc_id, md_content); trailing empty lines are kept, a null text has none."""
    s = docs.select("doc_id", F.posexplode(fenced_lines(F.col("md_content"))).alias("line_no", "x")).select("doc_id", "line_no", "x.line", "x.in_fence")
    return s.withColumn("heading_level", F.when(F.col("in_fence"), 0).otherwise(heading_level(F.col("line"))).cast("int"))


_SECTION = "section_idx int, heading_level int, title string, parent_title string, heading_path array<string>, body string"


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    for batch in batches:
        for i, (text, title) in enumerate(zip(batch.column("md_content").to_pylist(), batch.column("file_title").to_pylist(), strict=True)):
            found = splitter.sections(text, title) if text is not None else []
            columns = [pa.array([getattr(s, c) for s in found], k) for c, k in zip(("index", "level", "title", "parent", "path", "body"), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([i] * len(found), pa.int32())), *columns], ["doc_id", *(x.split()[0] for x in _SECTION.split(", "))])


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_idx, heading_level, title, parent_title, heading_path, body of docs (doc_id, md_content, file_title).

    Text before the first heading is a section of level 0 named after the file, unless it is blank; a heading
    without a text below it is a section with an empty body. A null text has no sections; repeated rows have theirs each.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "md_content", "file_title").mapInArrow(_sections, f"doc_id long, {_SECTION}")


def rendered(title: Column, body: Column) -> Column:
    """Title and body with a blank line between them, an empty side left out."""
    return F.concat_ws("\n\n", T.filled(title), F.nullif(F.btrim(body, F.lit("\n")), F.lit("")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, n, kind, atomic, text) for i, body in enumerate(batch.column("body").to_pylist()) if body is not None for n, (text, kind, atomic) in enumerate(splitter.blocks(body))]
        of = pa.array([x[0] for x in found], pa.int32())
        columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.bool_(), pa.string()), 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("section_idx").take(of), *columns], ["doc_id", "section_idx", "block_no", "kind", "atomic", "text"])


def blocks(parts: DataFrame) -> DataFrame:
    """parts (doc_id, section_idx, body) as block_no, kind, atomic, text: fences, image lines and link lines alone, text between them."""
    rows = parts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("section_idx").cast("int").alias("section_idx"), "body")
    return rows.mapInArrow(_blocks, "doc_id long, section_idx int, block_no int, kind string, atomic boolean, text string")
