"""The library in SQL: functions to be called by name, once register(spark) has made them known to a session.

    SELECT d.doc_id, s.section_idx, b.kind, b.text
    FROM docs d, LATERAL sections(d.md_content, d.file_title) s, LATERAL blocks(s.body) b

    SELECT * FROM chunks(TABLE(docs) PARTITION BY doc_id, max_length => 2000, min_length => 500, overlap => 1)

    SELECT linearized(md_content) FROM docs

Table functions take columns of the row beside them (LATERAL), and no row leaves its task; chunks takes a whole table, by documents.
What a call may be given is checked when the query is analysed, before any job.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .config import SplitConfig
from .errors import ConfigError, FieldError, SplitError
from .operators import chunking, tables
from .plans import context, documents, html, splitter
from .plans import tables as plain

_STRINGS, _WHOLE = (K.StringType, K.NullType), (K.ByteType, K.ShortType, K.IntegerType, K.LongType)


_TYPES = {"int": K.IntegerType(), "long": K.LongType(), "boolean": K.BooleanType(), "string": K.StringType(), "array<string>": K.ArrayType(K.StringType()), "array<int>": K.ArrayType(K.IntegerType())}


def _rows(schema: str) -> AnalyzeResult:
    """Rows of 'name type, ...'; calls are analysed in workers, where no session can read a schema."""
    return AnalyzeResult(K.StructType([K.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in schema.split(", "))]))


def _checked(schema: str, **arguments: tuple[AnalyzeArgument, tuple]) -> AnalyzeResult:
    """The rows that a function gives; FieldError if an argument is a table or of none of its types."""
    for name, (given, kinds) in arguments.items():
        if given.isTable or not isinstance(given.dataType, kinds):
            raise FieldError(f"{name} must be {'text' if kinds is _STRINGS else 'a whole number'}, not {'a table' if given.isTable else given.dataType.simpleString()}", "sql")
    return _rows(schema)


class Sections:
    """The sections of a Markdown text; none of a null one."""

    @staticmethod
    def analyze(md_content: AnalyzeArgument, file_title: AnalyzeArgument) -> AnalyzeResult:
        return _checked("section_idx int, heading_level int, title string, parent_title string, heading_path array<string>, body string", md_content=(md_content, _STRINGS), file_title=(file_title, _STRINGS))

    def eval(self, md_content: str | None, file_title: str | None) -> Iterator[tuple]:
        for s in splitter.sections(md_content, file_title) if md_content is not None else ():
            yield s.index, s.level, s.title, s.parent, list(s.path), s.body


class Blocks:
    """The blocks of a section's body: fences, image lines and link lines alone, text between them; none of a null one."""

    @staticmethod
    def analyze(body: AnalyzeArgument) -> AnalyzeResult:
        return _checked("block_no int, kind string, atomic boolean, text string", body=(body, _STRINGS))

    def eval(self, body: str | None) -> Iterator[tuple]:
        for n, (text, kind, atomic) in enumerate(splitter.blocks(body) if body is not None else ()):
            yield n, kind, atomic, text


class Pieces:
    """The pieces of at most size characters that a text is cut into at the coarsest separator that occurs; none of a null one. At their ends go the characters in spaces, if given, or all white space."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, spaces: AnalyzeArgument | None = None) -> AnalyzeResult:
        if size.isConstantExpression and isinstance(size.value, int) and size.value < 1:
            raise ConfigError("a piece must have room for a character", "sql")
        return _checked("piece_no int, piece string", text=(text, _STRINGS), size=(size, _WHOLE), **({} if spaces is None else {"spaces": (spaces, _STRINGS)}))

    def eval(self, text: str | None, size: int | None, spaces: str | None = None) -> Iterator[tuple]:
        for n, piece in enumerate(splitter.recursive_split(text, size, spaces=spaces) if text is not None and size else ()):
            yield n, piece


class Sentences:
    """The sentences of a text, stripped; none of a null one."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _checked("sentence_no int, sentence string", text=(text, _STRINGS))

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from enumerate(splitter.split_sentences(text) if text is not None else ())


class Cells:
    """The cells of the rectangle that an HTML or a pipe table covers, and what kind of table it is; none if it can't be read."""

    @staticmethod
    def analyze(raw: AnalyzeArgument) -> AnalyzeResult:
        return _checked("row_no int, column_no int, value string, table_type string", raw=(raw, _STRINGS))

    def eval(self, raw: str | None) -> Iterator[tuple]:
        try:
            grid, header = html.grid(raw) if "<" in (raw or "")[:64] and "|" not in raw.lstrip()[:1] else plain.pipe_grid((raw or "").split("\n"))
        except ValueError:
            return
        kind = plain.table_type(grid, header)
        for i, row in enumerate(grid):
            for j, value in enumerate(row):
                yield i, j, value, kind


class Contexts:
    """Heading, text before and text after of lines (from 0) of a Markdown text, up to limit characters each."""

    @staticmethod
    def analyze(md_content: AnalyzeArgument, places: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        return _checked("line_no int, heading string, pre_text string, post_text string", md_content=(md_content, _STRINGS), places=(places, (K.ArrayType,)), limit=(limit, _WHOLE))

    def eval(self, md_content: str | None, places: list[int] | None, limit: int) -> Iterator[tuple]:
        known = [x for x in places if x is not None] if places is not None and md_content is not None else []
        for at, found in zip(known, context.contexts(md_content, known, limit) if known else (), strict=True):
            yield at, *found


class Chunks:
    """The chunks of a table of documents (doc_id, md_content, file_title, md_path), in partitions of whole documents; a document that can't be split is a row with an error."""

    SCHEMA = f"{documents.CHUNK}, error_class string, error_message string"
    NEEDED = ("doc_id", "md_content", "file_title", "md_path")

    @staticmethod
    def analyze(docs: AnalyzeArgument, max_length: AnalyzeArgument, min_length: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not docs.isTable:
            raise FieldError("docs must be a table", "sql")
        lacking = [c for c in Chunks.NEEDED if c not in docs.dataType.names]
        if lacking:
            raise FieldError(f"docs lacks {', '.join(lacking)}", "sql")
        sizes = {"max_length": max_length, "min_length": min_length, "overlap": overlap}
        if not all(x.isConstantExpression for x in sizes.values()):
            raise ConfigError("sizes must be constants", "sql")
        SplitConfig(*(x.value for x in sizes.values()))
        return _rows(Chunks.SCHEMA)

    def eval(self, docs: Row, max_length: int, min_length: int, overlap: int) -> Iterator[tuple]:
        if docs["md_content"] is None:
            return
        try:
            for c in splitter.chunks(docs["md_content"], docs["file_title"] or "", docs["md_path"], SplitConfig(max_length, min_length, overlap)):
                yield docs["doc_id"], *c.values(), None, None
        except SplitError as e:
            yield docs["doc_id"], *[None] * 11, "SplitError", e.message


TABLE_FUNCTIONS = {"sections": Sections, "blocks": Blocks, "recursive_split": Pieces, "text_sentences": Sentences, "table_cells": Cells, "line_contexts": Contexts, "chunks": Chunks}
FUNCTIONS = {"linearized": tables.linearized, "html_grid": tables.html_grid, "split_recursively": chunking.recursive_split, "pack_pieces": chunking.pack_pieces}


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to SQL in this session. Registering again replaces them by themselves."""
    for name, kind in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(kind, useArrow=True))
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    return spark
