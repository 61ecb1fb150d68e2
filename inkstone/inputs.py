"""Inputs for the queries, derived from the tables by rules that Spark and other SQL engines state alike.

The tables hold no Markdown, so documents get headings, fences, images, links and tables by line number; file
paths and tables are made of ids and names, in many shapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What line {n} (from 0), reading {x}, of document {d} becomes. All text is kept; what is long for a heading goes on below it.
LINE = """CASE ({d} + {n} * 3) % 8
  WHEN 1 THEN CASE WHEN trim({x}) <> '' THEN repeat('#', cast(1 + ({d} + {n}) % 6 AS int)) || ' ' || substr({x}, 1, 40) || CASE WHEN length({x}) > 40 THEN chr(10) || substr({x}, 41) ELSE '' END ELSE {x} END
  WHEN 2 THEN {x} || chr(10)
  WHEN 3 THEN '```' || CASE WHEN ({d} + {n}) % 2 = 0 THEN 'py' ELSE '' END || chr(10) || '# code ' || {n} || chr(10) || {x}
              || CASE WHEN {d} % 13 = 0 THEN '' ELSE chr(10) || '```' END
  WHEN 4 THEN '![fig ' || {n} || '](images/' || ({d} + {n}) % 5 || '.png)' || chr(10) || {x}
  WHEN 5 THEN '[link ' || {n} || '](http://example.org/' || {n} || ')' || chr(10) || {x}
  WHEN 6 THEN '| a | b' || {n} || ' |' || chr(10) || '|---|---|' || chr(10) || '| ' || replace(substr({x}, 1, 12), '|', '/') || ' | ' || {n} || ' |' || chr(10) || {x}
  WHEN 7 THEN '## Head ' || {d} % 3 || chr(10) || {x}
  ELSE {x} END"""

EXTENSIONS = (".md", ".MD", ".pdf", ".markdown", ".txt", ".PDF", "")
#: A file path for document {d}; {ext} is its extension.
PATH = "CASE WHEN {d} % 11 = 0 THEN NULL WHEN {d} % 12 = 0 THEN '  ' ELSE CASE WHEN {d} % 5 = 0 THEN '  ' ELSE '' END || '/in/' || source || '/doc ' || {d} || {ext} END"

#: How an engine makes a list of {n} values from their numbers, and joins one; {esc} is a backslash in a literal.
SPARK = {"each": "transform(sequence(0, {n} - 1), {x} -> {body})", "join": "array_join({xs}, {sep})", "esc": "\\\\"}
DUCKDB = {"each": "list_transform(range({n}), lambda {x}: {body})", "join": "array_to_string({xs}, {sep})", "esc": "\\"}


def _joined(engine: dict[str, str], n: str, x: str, body: str, sep: str) -> str:
    return engine["join"].format(xs=engine["each"].format(n=n, x=x, body=body), sep=sep)


#: Pipe tables: columns, rows below the first, and what is shown in row {i} (0 is the first), column {j}. A third of them has a line
#: of rules below the first row, another third one that is too short to count and so is a row; some rows lack their last cell.
PIPE_COLUMNS, PIPE_ROWS = "cast(2 + floor(p_partkey / 3) % 3 AS int)", "cast(1 + p_partkey % 4 AS int)"
PIPE_SHOWN = "CASE (p_partkey + 2 * {i} + 3 * {j}) % 6 WHEN 0 THEN '' WHEN 1 THEN trim(p_brand) WHEN 2 THEN 'x|y' WHEN 3 THEN '' || p_size WHEN 4 THEN trim(p_name) ELSE 'w' || {i} || {j} END"
PIPE_LACKS = "((p_partkey + {i}) % 4 = 0 AND {i} > 0 AND {j} = {columns} - 1)"


def pipe(engine: dict[str, str]) -> str:
    """A pipe table for a part."""
    cell = f"replace({PIPE_SHOWN}, '|', '{engine['esc']}|')"
    line = lambda i: "'| ' || " + _joined(engine, f"({PIPE_COLUMNS} - CASE WHEN {PIPE_LACKS.format(i=i, j=f'{PIPE_COLUMNS} - 1', columns=PIPE_COLUMNS)} THEN 1 ELSE 0 END)", "j", cell.format(i=i, j="j"), "' | '") + " || ' |'"
    rules = "CASE (p_partkey + j) % 3 WHEN 0 THEN ':---' WHEN 1 THEN '---' ELSE ':-----:' END"
    below = f"CASE p_partkey % 3 WHEN 0 THEN chr(10) || '|' || {_joined(engine, PIPE_COLUMNS, 'j', rules, chr(39) + '|' + chr(39))} || '|' WHEN 1 THEN chr(10) || '| --- |' ELSE '' END"
    return f"{line('0')} || {below} || chr(10) || {_joined(engine, PIPE_ROWS, 'i', line('(i + 1)'), 'chr(10)')}"


#: HTML tables: rows, columns, and what is shown where a cell begins. In the first column some cells are two rows high, in the second one each is as many
#: columns wide as HTML_WIDE says; a third of the tables has headers in its first row.
HTML_ROWS, HTML_COLUMNS = "cast(2 + p_partkey % 4 AS int)", "cast(2 + floor(p_partkey / 4) % 3 AS int)"
HTML_SHOWN = "CASE (p_partkey + 2 * {i} + 3 * {j}) % 7 WHEN 0 THEN '' WHEN 1 THEN trim(p_brand) WHEN 2 THEN 'a > b' WHEN 3 THEN p_size || ' mm' WHEN 4 THEN trim(p_name) ELSE 'v' || {i} || '.' || {j} END"
HTML_TALL = "({i} % 2 = 0 AND {i} + 1 < {rows} AND (p_partkey + {i}) % 3 = 0)"
HTML_WIDE = "(1 + (p_partkey + {i}) % ({columns} - 1))"


def html(engine: dict[str, str]) -> str:
    """An HTML table for a part."""
    kind = "CASE WHEN i = 0 AND p_partkey % 3 = 0 THEN 'th' ELSE 'td' END"
    written = lambda j: f"replace(replace({HTML_SHOWN.format(i='i', j=j)}, 'a > b', 'a &gt; b'), p_size || ' mm', '<b>' || p_size || '</b> mm')"
    cell = lambda j, spans: f"'<' || {kind} || {spans} || '>' || {written(j)} || '</' || {kind} || '>'"
    tall, wide = HTML_TALL.format(i="i", rows=HTML_ROWS), HTML_WIDE.format(i="i", columns=HTML_COLUMNS)
    hidden = f"(i % 2 = 1 AND {HTML_TALL.format(i='(i - 1)', rows=HTML_ROWS)})"
    first = f"CASE WHEN {hidden} THEN '' ELSE {cell('0', f"CASE WHEN {tall} THEN ' rowspan=" + chr(34) + "2" + chr(34) + f"' ELSE '' END")} END"
    rest = " || ".join(f"CASE WHEN {HTML_COLUMNS} > {j} AND {wide} < {j} THEN {cell(j, chr(39) * 2)} ELSE '' END" for j in (2, 3))
    row = f"'<tr>' || {first} || {cell('1', f"' colspan=' || {wide}")} || {rest} || '</tr>'"
    return "'<table class=\"t\">' || " + _joined(engine, HTML_ROWS, "i", row, "''") + " || '</table>'"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """df in a partition for each slot at least: a small file of short rows would keep one slot busy with all that is made of them."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, md_content, file_title, md_path."""
    body = f"array_join(transform(split(text, chr(10), -1), (x, i) -> {LINE.format(d='doc_id', n='i', x='x')}), chr(10))"
    return table(spark, d, "documents").select("doc_id", F.expr(body).alias("md_content"), F.expr("'doc' || doc_id").alias("file_title"), F.expr("'/in/' || source || '/doc' || doc_id || '.md'").alias("md_path"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, import_file_path."""
    ext = "element_at(array(" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "), cast(doc_id % 7 + 1 AS int))"
    return table(spark, d, "documents").select("doc_id", F.expr(PATH.format(d="doc_id", ext=ext)).alias("import_file_path"))


def pipe_tables(spark: SparkSession, d: str) -> DataFrame:
    parts = _dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return parts.select("*", F.expr(pipe(SPARK)).alias("raw"))


def html_tables(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(html(SPARK)).alias("raw"))


def images(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, image_name, path, summary, url of three image files beside each document; the third is uploaded nowhere."""
    three = F.explode(F.array(F.lit(0), F.lit(1), F.lit(7))).alias("k")
    s = table(spark, d, "documents").select("doc_id", three)
    path = F.expr("'/in/' || doc_id || '/images/' || k || '.PNG'")
    return s.select(
        "doc_id",
        F.expr("k || '.PNG'").alias("image_name"),
        path.alias("path"),
        F.expr("case when k = 0 then '' else ' seen [' || k || ']  in ' || doc_id end").alias("summary"),
        F.when(F.col("k") == 1, path).otherwise(F.expr("'http://store/b/' || doc_id || '/' || k || '.PNG'")).alias("url"),
    )
