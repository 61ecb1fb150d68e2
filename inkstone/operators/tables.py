"""Pipe and HTML tables as rectangles and sentences, as Column expressions and Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T
from ..plans import html
from ..plans import tables as plain

# Formats of the input and wording of the output.
TABLE_CLOSES = r"(?iU)</table[\s\x1c-\x1f]*>"
TABLE_OPENS = r"(?iU)<table\b"
SEPARATOR = r"\A:?-{3,}:?\z"


_TABLE = "doc_id long, table_no int, first_line int, n_lines int, raw string"


def _pipe_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _TABLE.split(", ")]
    for batch in batches:
        found = [(i, n, first, len(rows), "\n".join(rows)) for i, text in enumerate(batch.column("md_content").to_pylist()) if text and "|" in text for n, (first, rows) in enumerate(plain.pipe_tables(text))]
        of = batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int32()))
        yield pa.RecordBatch.from_arrays([of, *(pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string()), 1))], names)


def pipe_tables(docs: DataFrame) -> DataFrame:
    """doc_id, table_no, first_line, n_lines, raw of docs (doc_id, md_content): runs of two or more pipe lines outside fences, of any length."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "md_content").mapInArrow(_pipe_tables, _TABLE)


def html_tables(text: Column) -> Column:
    """The HTML tables of a text, each from an opening tag up to the nearest closing one: what stands between closing tags is looked at once."""
    before = F.arrays_zip(F.split(text, TABLE_CLOSES, -1).alias("part"), F.regexp_extract_all(text, F.lit(TABLE_CLOSES), F.lit(0)).alias("close"))
    begin = lambda x: F.regexp_instr(x["part"], F.lit(TABLE_OPENS))
    table = lambda x: F.when(begin(x) > 0, F.substring(x["part"], begin(x), F.length(x["part"])))
    found = F.transform(before, lambda x: F.when(table(x).contains(">"), F.concat(table(x), x["close"])))
    return F.filter(found, lambda x: x.isNotNull())


def pipe_cells(line: Column) -> Column:
    """Cells between the unescaped pipes of a line; null if it doesn't begin and end with one."""

    def cells(s: Column) -> Column:
        inner = F.substring(s, F.lit(2), F.length(s) - 2)
        found = F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: T.strip(F.replace(c, F.lit("\\|"), F.lit("|"))))
        return F.when(s.startswith("|") & s.endswith("|") & (F.length(s) > 1), found)

    return T.once(T.strip(line), cells)


def pipe_grid(raw: Column) -> Column:
    """struct<grid, header> of a pipe table: ragged rows filled with '', the separator line taken out; null if a line is none."""

    def filled(rows: Column) -> Column:
        full = lambda width: F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        return F.when(~F.exists(rows, lambda r: r.isNull()), T.once(F.array_max(F.transform(rows, F.size)), full))

    def parted(full: Column) -> Column:
        def told(ruled: Column) -> Column:
            rest = F.slice(full, F.lit(3), F.greatest(F.size(full) - 2, F.lit(0)))
            grid = F.when(ruled, F.concat(F.slice(full, 1, 1), rest)).otherwise(full)
            return F.when(full.isNotNull(), F.struct(grid.alias("grid"), ruled.alias("header")))

        return T.once(F.coalesce(F.forall(F.get(full, F.lit(1)), lambda c: c.rlike(SEPARATOR)), F.lit(False)), told)

    lines = F.filter(F.split(raw, "\n", -1), lambda x: T.strip(x) != "")
    return T.once(T.once(F.transform(lines, pipe_cells), filled), parted)


def table_type(grid: Column, header: Column) -> Column:
    return T.once(
        F.get(grid, F.lit(0)),
        lambda first: (
            F.when(first.isNull() | (F.size(first) == 0), "unknown")
            .when((F.size(first) > 2) & (T.strip(first[0]) == ""), "cross_table")
            .when((F.size(first) == 2) & ~header, "kv_table")
            .otherwise("header_table")
        ),
    )


def _data(grid: Column) -> Column:
    return F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0)))


def _lines(xs: Column) -> Column:
    return F.array_join(F.filter(xs, lambda x: x.isNotNull()), "\n")


def header_sentences(grid: Column) -> Column:
    """A line per data row with heading:value for each value; headings alone if there are no data."""

    def fact(xs: Column) -> Column:
        return F.concat(F.lit("- 【"), F.array_join(xs, "，"), F.lit("】"))

    def row(heads: Column, r: Column) -> Column:
        facts = F.filter(F.zip_with(heads, r, lambda h, v: F.concat(h, F.lit(":"), T.filled(v))), lambda x: x.isNotNull())
        return T.once(facts, lambda xs: F.when(F.size(xs) > 0, fact(xs)))

    def told(heads: Column) -> Column:
        alone = F.when(F.exists(grid[0], lambda h: T.strip(h) != ""), fact(heads)).otherwise("")
        return T.once(_lines(F.transform(_data(grid), lambda r: row(heads, r))), lambda data: F.when(data != "", data).otherwise(alone))

    return T.once(F.transform(grid[0], lambda h, i: F.coalesce(T.filled(h), F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("列")))), told)


def cross_sentences(grid: Column) -> Column:
    """A line per value with its row's and its column's heading."""

    def row(r: Column, i: Column) -> Column:
        name = F.coalesce(T.filled(r[0]), F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("行")))
        heads, values = F.slice(grid[0], F.lit(2), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1)
        return F.zip_with(heads, values, lambda h, v: F.concat(F.lit("- "), name, F.lit("的"), F.coalesce(T.filled(h), F.lit("未命名列")), F.lit("标准为"), T.filled(v)))

    return _lines(F.flatten(F.transform(_data(grid), row)))


def kv_sentences(grid: Column) -> Column:
    """A line per row that has both a key and a value."""
    return _lines(F.transform(grid, lambda r: F.concat(F.lit("- "), T.filled(r[0]), F.lit("："), T.filled(r[1]))))


def sentences(grid: Column, kind: Column) -> Column:
    text = lambda g: F.when(kind == "header_table", header_sentences(g)).when(kind == "cross_table", cross_sentences(g)).when(kind == "kv_table", kv_sentences(g)).otherwise("")
    return T.once(grid, text)


def replaced(raw: Column, text: Column) -> Column:
    """text between the marks of a rewritten table, or raw where there is no text."""
    return T.once(text, lambda t: F.when(t != "", F.concat(F.lit(plain.OPEN + "\n"), t, F.lit("\n" + plain.CLOSE))).otherwise(raw))


_GRID = K.StructType([K.StructField("grid", K.ArrayType(K.ArrayType(K.StringType()))), K.StructField("header", K.BooleanType())])


@F.arrow_udf(_GRID)
def html_grid(raw: pa.Array) -> pa.Array:
    """struct<grid, header> of HTML tables; null where one can't be projected."""
    out = []
    for x in raw.to_pylist():
        try:
            grid, header = html.grid(x or "")
            out.append({"grid": grid, "header": header})
        except ValueError:
            out.append(None)
    return pa.array(out, pa.struct([("grid", pa.list_(pa.list_(pa.string()))), ("header", pa.bool_())]))


@F.arrow_udf(K.StringType())
def linearized(text: pa.Array) -> pa.Array:
    """Texts with the tables outside fences as sentences."""
    return pa.array([None if x is None else plain.linearized(x) for x in text.to_pylist()], pa.string())
