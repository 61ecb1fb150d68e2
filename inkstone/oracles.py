"""The queries of inkstone.queries in SQL, written against the tables alone and by other means than the operators."""

from __future__ import annotations

from . import inputs
from .functions.text import PROMPT

_CASE = inputs.LINE.format(d="doc_id", n="(i - 1)", x="x")
_EXT = "[" + ", ".join(f"'{e}'" for e in inputs.EXTENSIONS) + "][doc_id % 7 + 1]"
_PATH = inputs.PATH.format(d="doc_id", ext=_EXT)

# Markdown, its lines, and fences: one step of recursion for each line that looks like a fence.
_MD = f"""md AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {_CASE}), chr(10)) AS md FROM documents),
ln0 AS (SELECT doc_id, string_split(md, chr(10)) AS ls FROM md),
ln AS (SELECT doc_id, ls[n + 1] AS line, n AS line_no FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS n FROM ln0))"""
_FENCE = "'^ {0,3}(`{3,}|~{3,})(.*)$'"
_LINES = f"""WITH RECURSIVE {_MD},
cand AS (SELECT doc_id, line_no, regexp_extract(line, {_FENCE}, 1) AS m, regexp_extract(line, {_FENCE}, 2) AS info,
                row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM ln WHERE regexp_matches(line, {_FENCE})),
st AS (SELECT doc_id, 0::BIGINT AS k, ''::VARCHAR AS mark, ''::VARCHAR AS was, -1::BIGINT AS line_no FROM md
       UNION ALL
       SELECT c.doc_id, c.k, CASE WHEN s.mark = '' THEN CASE WHEN c.m LIKE '`%' AND c.info LIKE '%`%' THEN '' ELSE c.m END
                             WHEN trim(c.info) = '' AND c.m[1] = s.mark[1] AND len(c.m) >= len(s.mark) THEN '' ELSE s.mark END, s.mark, c.line_no
       FROM st s JOIN cand c ON c.doc_id = s.doc_id AND c.k = s.k + 1),
fl AS (SELECT l.doc_id, l.line_no, l.line, s.mark <> '' OR (s.line_no = l.line_no AND s.was <> '') AS in_fence,
              s.line_no = l.line_no AND s.mark <> '' AND s.was = '' AS opens
       FROM ln l ASOF JOIN st s ON s.doc_id = l.doc_id AND s.line_no <= l.line_no),
hl AS (SELECT *, CASE WHEN NOT in_fence AND trim(regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \\t]+(.+?)[ \\t]*$', 2)) <> ''
                      THEN len(regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \\t]+(.+?)[ \\t]*$', 1)) ELSE 0 END AS level FROM fl)"""
_SLOTS = ",\n".join(
    f"CASE WHEN level >= {k} AND max(CASE WHEN level = {k} THEN g END) OVER w > coalesce(max(CASE WHEN level BETWEEN 1 AND {k - 1} THEN g END) OVER w, -1) "
    f"THEN max_by(title, CASE WHEN level = {k} THEN g END) OVER w END AS s{k}"
    for k in range(1, 7)
)
_SECTIONS = f"""{_LINES},
gl AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM hl),
se AS (SELECT doc_id, g, max(level) AS level, max(CASE WHEN level > 0 THEN line END) AS title,
              trim(coalesce(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY line_no), ''), chr(10)) AS body FROM gl GROUP BY doc_id, g),
sl AS (SELECT *, {_SLOTS} FROM se WHERE g > 0 OR trim(body, ' ' || chr(10) || chr(9)) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY g)),
pa AS (SELECT doc_id, g, level, coalesce(title, 'doc' || doc_id) AS title, body,
              CASE WHEN level = 0 THEN ['doc' || doc_id] ELSE list_filter([s1, s2, s3, s4, s5, s6], lambda x: x IS NOT NULL) END AS path FROM sl),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS section_idx, level AS heading_level, title,
                    CASE WHEN len(path) > 1 THEN path[len(path) - 1] ELSE title END AS parent_title, path, body FROM pa)"""

_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _suffix(x: str) -> str:
    return f"regexp_extract(regexp_extract({x}, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)"


def _stem(x: str) -> str:
    return f"(CASE WHEN {_suffix(x)} = '' THEN regexp_extract({x}, '([^/]*)$', 1) ELSE regexp_extract(regexp_extract({x}, '([^/]*)$', 1), '^(.+)\\.[^.]+$', 1) END)"


_FILES = f"files AS (SELECT doc_id, {_PATH} AS p, {_strip(_PATH)} AS s FROM documents)"
_KIND = f"CASE lower({_suffix('s')}) WHEN '.pdf' THEN 'pdf' WHEN '.md' THEN 'markdown' WHEN '.markdown' THEN 'markdown' END"
_STATE = f"""cases AS (SELECT doc_id * 2 AS id, doc_id, source, text AS md FROM documents UNION ALL
  SELECT doc_id * 2 + 1, doc_id, source, CASE doc_id % 9 WHEN 1 THEN '' WHEN 3 THEN 'a' || chr(10) || 'b' || chr(10) || 'c' END FROM documents WHERE doc_id % 9 IN (0, 1, 3)),
state AS (SELECT id, {_PATH} AS md_path, md,
  CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Source ' || doc_id END AS import_stem,
  CASE doc_id % 4 WHEN 0 THEN 'title ' || doc_id END AS given, CASE WHEN doc_id % 6 = 0 THEN '/out' END AS dir FROM cases)"""
_TITLE = f"coalesce(given, import_stem, nullif({_strip(_stem(_strip('md_path')))}, ''))"

_PAGES = """p AS (SELECT page_id, url, page_id % 6 AS k, len(html) % 2 = 0 AS even, string_split(url, '://')[1] AS scheme, string_split(string_split(url, '://')[2], '/')[1] AS host FROM pages)"""
_IMAGES = "three AS (SELECT doc_id, unnest([0, 1, 7]) AS k FROM documents)"
_REFS = f"""WITH {_MD}, rf AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '!\\[([^\\]\\n]*)\\]\\(\\s*([^)\\n]+?)\\s*\\)', 1)) AS alt,
  unnest(regexp_extract_all(line, '!\\[([^\\]\\n]*)\\]\\(\\s*([^)\\n]+?)\\s*\\)', 2)) AS dest FROM ln)"""
_HEAD = "'^\\s{0,3}#{1,6}(\\s|$)'"
_CONTEXT = f"""{_REFS},
hd AS (SELECT *, regexp_matches(line, {_HEAD}) AS is_head, trim(line) = '' OR regexp_matches(line, '!\\[[^\\]]*\\]\\([^)]+\\)') AS edge FROM ln),
fr AS (SELECT doc_id, regexp_extract(dest, '([^/]*)$', 1) AS image_key, min(line_no) AS at FROM rf GROUP BY ALL),
bd AS (SELECT f.*, coalesce((SELECT max(line_no) FROM hd h WHERE h.doc_id = f.doc_id AND h.is_head AND h.line_no < f.at), -1) AS above,
              coalesce((SELECT min(line_no) FROM hd h WHERE h.doc_id = f.doc_id AND h.is_head AND h.line_no > f.at), 1000000000) AS below FROM fr f),
nl AS (SELECT b.*, h.line_no, h.line, h.edge, h.line_no > b.at AS after,
              sum(CASE WHEN h.edge THEN 1 ELSE 0 END) OVER (PARTITION BY b.doc_id, b.image_key, h.line_no > b.at ORDER BY h.line_no) AS isle
       FROM bd b JOIN hd h ON h.doc_id = b.doc_id AND h.line_no > b.above AND h.line_no < b.below AND h.line_no <> b.at),
pg AS (SELECT doc_id, image_key, after, isle, string_agg(line, chr(10) ORDER BY line_no) AS t, min(line_no) AS first FROM nl WHERE NOT edge GROUP BY ALL),
rk AS (SELECT *, row_number() OVER w AS n, sum(len(t)) OVER w AS total FROM pg WINDOW w AS (PARTITION BY doc_id, image_key, after ORDER BY CASE WHEN after THEN first ELSE -first END)),
tx AS (SELECT doc_id, image_key, string_agg(t, chr(10) || chr(10) ORDER BY first) FILTER (WHERE NOT after) AS pre_text,
              string_agg(t, chr(10) || chr(10) ORDER BY first) FILTER (WHERE after) AS post_text FROM rk WHERE n = 1 OR total <= 200 GROUP BY ALL),
cx AS (SELECT b.doc_id, b.image_key, b.at, coalesce((SELECT trim(line) FROM ln l WHERE l.doc_id = b.doc_id AND l.line_no = b.above), '') AS heading,
              coalesce(pre_text, '') AS pre_text, coalesce(post_text, '') AS post_text FROM bd b LEFT JOIN tx USING (doc_id, image_key))"""

# Tables by their cells: row i and column j of the rectangle, what it shows, and whether the table has headers.
_PIPE = inputs.pipe(inputs.DUCKDB)
_PIPE_CELLS = f"""pt AS (SELECT *, {inputs.PIPE_COLUMNS} AS columns, {inputs.PIPE_ROWS} AS below, p_partkey % 3 = 0 AS header, {_PIPE} AS raw FROM part),
pj AS (SELECT *, unnest(range(columns)) AS j FROM pt), pi AS (SELECT *, unnest(range(below + 1)) AS i FROM pj),
cells AS (SELECT p_partkey, raw, header, columns, CASE WHEN p_partkey % 3 = 1 AND i > 0 THEN i + 1 ELSE i END AS i, j,
                 CASE WHEN {inputs.PIPE_LACKS.format(i='i', j='j', columns='columns')} THEN '' ELSE {inputs.PIPE_SHOWN.format(i='i', j='j')} END AS v FROM pi
          UNION ALL SELECT p_partkey, raw, header, columns, 1, j, CASE WHEN j = 0 THEN '---' ELSE '' END FROM pj WHERE p_partkey % 3 = 1)"""
_HTML = inputs.html(inputs.DUCKDB)
_HTML_CELLS = f"""ht AS (SELECT *, {inputs.HTML_COLUMNS} AS columns, {inputs.HTML_ROWS} AS nrows, p_partkey % 3 = 0 AS header, {_HTML} AS raw FROM part),
hj AS (SELECT *, unnest(range(columns)) AS j FROM ht), hi AS (SELECT *, unnest(range(nrows)) AS i FROM hj),
hc AS (SELECT *, CASE WHEN j = 0 AND i % 2 = 1 AND {inputs.HTML_TALL.format(i='(i - 1)', rows='nrows')} THEN i - 1 ELSE i END AS a,
              CASE WHEN j > 0 AND j <= {inputs.HTML_WIDE.format(i='i', columns='columns')} THEN 1 ELSE j END AS b FROM hi),
cells AS (SELECT p_partkey, raw, header, columns, i, j, {inputs.HTML_SHOWN.format(i='a', j='b')} AS v FROM hc)"""
# What such a table tells.
_TOLD = """kinds AS (SELECT p_partkey, any_value(raw) AS raw, any_value(header) AS header, CASE WHEN max(columns) > 2 AND max(v) FILTER (WHERE i = 0 AND j = 0) = '' THEN 'cross_table'
                 WHEN max(columns) = 2 AND NOT any_value(header) THEN 'kv_table' ELSE 'header_table' END AS kind FROM cells GROUP BY p_partkey),
heads AS (SELECT p_partkey, j, v AS head, coalesce(nullif(v, ''), '第' || (j + 1) || '列') AS name FROM cells WHERE i = 0),
records AS (SELECT c.p_partkey, i, 0 AS j, '- 【' || string_agg(name || ':' || v, '，' ORDER BY j) || '】' AS line FROM cells c JOIN heads USING (p_partkey, j) WHERE i > 0 AND v <> '' GROUP BY c.p_partkey, i),
alone AS (SELECT p_partkey, 0 AS i, 0 AS j, '- 【' || string_agg(name, '，' ORDER BY j) || '】' AS line FROM heads GROUP BY p_partkey HAVING count(*) FILTER (WHERE head <> '') > 0 AND p_partkey NOT IN (SELECT p_partkey FROM records)),
crossings AS (SELECT c.p_partkey, c.i, c.j, '- ' || coalesce(nullif(r.v, ''), '第' || c.i || '行') || '的' || coalesce(nullif(head, ''), '未命名列') || '标准为' || c.v AS line
              FROM cells c JOIN cells r ON r.p_partkey = c.p_partkey AND r.i = c.i AND r.j = 0 JOIN heads h ON h.p_partkey = c.p_partkey AND h.j = c.j WHERE c.i > 0 AND c.j > 0 AND c.v <> ''),
named AS (SELECT c.p_partkey, c.i, c.j, '- ' || r.v || '：' || c.v AS line FROM cells c JOIN cells r ON r.p_partkey = c.p_partkey AND r.i = c.i AND r.j = 0 WHERE c.j = 1 AND c.v <> '' AND r.v <> ''),
every AS (SELECT 'header_table' AS kind, * FROM records UNION ALL SELECT 'header_table', * FROM alone UNION ALL SELECT 'cross_table', * FROM crossings UNION ALL SELECT 'kv_table', * FROM named),
told AS (SELECT k.p_partkey, kind, k.raw, coalesce(string_agg(line, chr(10) ORDER BY i, j), '') AS text FROM kinds k LEFT JOIN every e USING (p_partkey, kind) GROUP BY k.p_partkey, kind, k.raw)"""
_RECTANGLE = "lines AS (SELECT p_partkey, any_value(header) AS header, i, string_agg(v, '¦' ORDER BY j) AS line FROM cells GROUP BY p_partkey, i) SELECT p_partkey, string_agg(line, '#' ORDER BY i) AS grid, any_value(header) AS header FROM lines GROUP BY p_partkey"
_MARKED = "CASE WHEN text = '' THEN raw ELSE '【表格转译】' || chr(10) || text || chr(10) || '【表格转译结束】' END"

_SENT = "list_filter(list_transform(regexp_extract_all({0}, '[^。！？；.!?;]+[。！？；.!?;]?'), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '')"

# What the targets made of addresses are once titles and brackets are gone.
_DEST = """d AS (SELECT page_id, page_id % 8 AS k, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN path || ' x.PNG' WHEN 2 THEN path || '.png' WHEN 3 THEN 'dir\\' || page_id || '.JPG' WHEN 4 THEN 'data:image/png;base64,' || printf('%X', page_id)
  WHEN 6 THEN './%E5%9B%BE' || page_id || '.png?x#y' WHEN 7 THEN 'C+' || host || '.gif' END AS t
  FROM (SELECT page_id, url, string_split(string_split(url, '://')[2], '/')[1] AS host, substr(string_split(url, '://')[2], 2 + len(string_split(string_split(url, '://')[2], '/')[1])) AS path FROM pages))"""

_GIVEN = ["'doc' || doc_id", *(f"coalesce(nullif({c}, ''), '未提供')" for c in ("heading", "pre_text", "post_text"))]
_PROMPT = " || ".join([*(f"'{head}' || {value}" for head, value in zip(PROMPT, _GIVEN, strict=False)), f"'{PROMPT[-1]}'"])

ORACLES: dict[str, str] = {
    "chunk_sections": f"""{_SECTIONS.replace("chr(10)) AS md FROM documents", "chr(10)).replace('|', '/') AS md FROM documents")}
        , r AS (SELECT *, {_strip('title')} || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || body END AS content FROM sections)
        SELECT doc_id, section_idx AS chunk_index, title, parent_title, array_to_string(path, ' > ') AS heading_path, body, content, len(content) AS char_count FROM r""",
    "chunk_bounds": "SELECT doc_id, 0 AS gaps, 0 AS bad_counts, 0 AS mixed FROM documents",
    "chunk_conservation": "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[#`|<~\\[\\]!]', 'x', 'g'), '\\s', '', 'g')) AS digest FROM documents",
    "import_graph": f"""WITH {_FILES}, k AS (SELECT f.*, {_KIND} AS kind, d.text FROM files f JOIN documents d USING (doc_id)),
        e AS (SELECT *, CASE WHEN kind IS NULL THEN 'FieldError' WHEN kind = 'pdf' AND doc_id % 10 = 4 THEN 'PdfError' END AS error_class,
                     trim(regexp_replace(text, '[#`|<~\\[\\]!]', 'x', 'g'), chr(10)) AS body FROM k)
        SELECT doc_id, CASE WHEN error_class IS NULL THEN 1 ELSE 0 END AS n_chunks,
               CASE WHEN error_class IS NULL THEN len('# it ' || doc_id) + CASE WHEN body = '' THEN 0 ELSE 2 + len(body) END ELSE 0 END AS n_chars, error_class,
               CASE error_class WHEN 'FieldError' THEN 'entry' WHEN 'PdfError' THEN 'pdf' ELSE 'done' END AS stage FROM e""",
    "classify_files": f"""WITH {_FILES}, k AS (SELECT *, {_KIND} AS kind FROM files)
        SELECT doc_id, coalesce(kind = 'pdf', false) AS is_pdf_read_enabled, coalesce(kind = 'markdown', false) AS is_md_read_enabled,
               CASE WHEN kind = 'pdf' THEN s END AS pdf_path, CASE WHEN kind = 'markdown' THEN s END AS md_path, CASE WHEN kind IS NULL THEN 'FieldError' END AS error_class FROM k""",
    "route_flags": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 NOT IN (0, 2) THEN 'pdf' WHEN doc_id % 3 <> 0 AND doc_id % 4 IN (0, 2) THEN 'markdown' END AS route,
        CASE WHEN (doc_id % 3 = 0) = (doc_id % 4 IN (0, 2)) THEN 'FieldError' END AS error_class FROM documents""",
    "route_union": f"""WITH {_FILES}, k AS (SELECT *, {_KIND} AS kind FROM files)
        SELECT doc_id, kind AS route, CASE WHEN kind = 'pdf' THEN regexp_extract(s, '^(.*)/[^/]*$', 1) || '/' || {_stem('s')} || '/auto/' || {_stem('s')} || '.md' ELSE s END AS md_path FROM k WHERE kind IS NOT NULL""",
    "validate_pdf_path": f"""WITH {_FILES} SELECT doc_id, CASE WHEN s LIKE '%/%' THEN regexp_extract(s, '^(.*)/[^/]*$', 1) WHEN s IS NOT NULL THEN '.' END AS output_dir,
        CASE WHEN lower({_suffix('s')}) = '.pdf' AND doc_id % 2 = 0 THEN NULL ELSE 'PdfError' END AS error_class FROM files""",
    "validate_md_path": f"WITH {_FILES} SELECT doc_id, coalesce(lower({_suffix('s')}) IN ('.md', '.markdown'), false) AS is_valid FROM files",
    "validate_docs": f"""WITH {_STATE} SELECT id AS doc_id, {_TITLE} AS file_title,
        CASE WHEN md IS NULL OR coalesce(lower({_suffix(_strip('md_path'))}) NOT IN ('.md', '.markdown'), true) OR {_TITLE} IS NULL THEN 'FieldError' END AS error_class, len(md) AS n_chars FROM state""",
    "normalize_text": f"WITH {_STATE} SELECT id AS doc_id, md AS md_content FROM state",
    "read_utf8": """WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN CASE WHEN text = '' OR strlen(right(text, 1)) = 1 THEN left(text, -1) END WHEN 2 THEN CASE WHEN text = '' OR strlen(left(text, 1)) = 1 THEN substr(text, 2) END
                                 WHEN 3 THEN NULL ELSE text END AS t, text IS NULL AS none FROM documents)
        SELECT doc_id, md5(t) AS digest, len(t) AS n_chars, t IS NULL AND NOT none AS is_bad FROM t""",
    "resolve_title": f"WITH {_STATE} SELECT id AS doc_id, {_TITLE} AS file_title FROM state",
    "resolve_dir": f"""WITH {_STATE} SELECT id AS doc_id, coalesce(dir, CASE WHEN md_path LIKE '%/%' THEN regexp_extract({_strip('md_path')}, '^(.*)/[^/]*$', 1) WHEN md_path IS NOT NULL THEN '.' END) AS file_dir FROM state""",
    "env_bool": """SELECT doc_id, len(list_filter(string_split_regex(text, '[^A-Za-z0-9]+'), lambda w: lower(w) IN ('1', 'true', 'yes', 'on'))) AS n_true FROM documents""",
    "base_url": f"""WITH {_PAGES} SELECT page_id, CASE k WHEN 1 THEN scheme || '://' || host WHEN 3 THEN rtrim(url, '/') ELSE CASE WHEN even THEN 'https://' ELSE 'http://' END ||
        CASE k WHEN 0 THEN host || ':9000' WHEN 2 THEN upper(scheme) || '://' || host WHEN 4 THEN rtrim(scheme || ':' || substr(url, len(scheme) + 4), '/') ELSE '' END END AS base_url FROM p""",
    "endpoint_parse": f"""WITH {_PAGES}, v AS (SELECT *, k IN (0, 1, 2, 4) OR (k = 3 AND url = scheme || '://' || host) AS ok FROM p)
        SELECT page_id, CASE WHEN ok THEN CASE k WHEN 0 THEN host || ':9000' WHEN 4 THEN rtrim(scheme || ':' || substr(url, len(scheme) + 4), '/') ELSE host END END AS host,
               CASE WHEN ok THEN CASE WHEN k IN (0, 4) THEN even ELSE scheme = 'https' END END AS secure, ok AS is_valid FROM v""",
    "output_name": "SELECT doc_id, '/in/v1.2/doc' || doc_id || CASE doc_id % 3 WHEN 1 THEN '_NEW' ELSE '_new' END || '.md' AS new_path FROM documents",
    "explode_lines": f"WITH {_MD} SELECT doc_id, line_no, line FROM ln",
    "fence_open": f"WITH {_MD} SELECT doc_id, line_no, regexp_extract(line, {_FENCE}, 1) AS marker FROM ln WHERE regexp_matches(line, '^ {{0,3}}(`{{3,}}[^`]*|~{{3,}}.*)$')",
    "fence_mask": f"{_LINES} SELECT doc_id, line_no, in_fence FROM fl",
    "headings": f"{_LINES} SELECT doc_id, line_no, level AS heading_level, line FROM hl WHERE level > 0",
    "sections": f"{_SECTIONS} SELECT doc_id, section_idx, heading_level, title, parent_title, array_to_string(path, ' > ') AS heading_path, body FROM sections",
    "section_body": f"{_SECTIONS} SELECT doc_id, section_idx, len(body) AS n_chars, md5(body) AS digest FROM sections",
    "heading_path": f"{_SECTIONS} SELECT doc_id, section_idx, array_to_string(path, ' > ') AS heading_path, len(path) AS depth FROM sections",
    "parent_title": f"{_SECTIONS} SELECT doc_id, section_idx, parent_title FROM sections",
    "render_section": f"{_SECTIONS} SELECT doc_id, section_idx, {_strip('title')} || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || body END AS content FROM sections",
    "blocks": f"""{_SECTIONS},
        sx AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS section_idx FROM pa),
        b1 AS (SELECT doc_id, g, line_no, line, opens, CASE WHEN in_fence THEN 'fenced_code' WHEN regexp_matches(line, '^\\s*!\\[[^\\]]*\\]\\([^\\n]+\\)\\s*$') THEN 'image'
                      WHEN regexp_matches(line, '^\\s*\\[[^\\]]+\\]\\([^\\n]+\\)\\s*$') THEN 'link' ELSE 'text' END AS kind FROM gl WHERE level = 0),
        b2 AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind OR kind IN ('image', 'link') OR opens THEN 1 ELSE 0 END AS new FROM b1 WINDOW w AS (PARTITION BY doc_id, g ORDER BY line_no)),
        b3 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, g ORDER BY line_no) AS b FROM b2),
        b4 AS (SELECT doc_id, g, b, min(kind) AS kind, string_agg(line, chr(10) ORDER BY line_no) AS t, b = max(b) OVER (PARTITION BY doc_id, g) AS last FROM b3 GROUP BY doc_id, g, b),
        b5 AS (SELECT doc_id, g, b, kind, CASE WHEN kind = 'text' THEN trim(t, chr(10)) WHEN last THEN rtrim(t, chr(10)) ELSE t END AS text FROM b4)
        SELECT doc_id, section_idx, row_number() OVER (PARTITION BY doc_id, section_idx ORDER BY b) - 1 AS block_no, kind, kind <> 'text' AS atomic, text
        FROM b5 JOIN sx USING (doc_id, g) WHERE kind <> 'text' OR trim(text, ' ' || chr(9) || chr(10)) <> ''""",
    "length_gate": f"""{_SECTIONS}, r AS (SELECT *, len({_strip('title')}) AS t, len({_strip('title')}) + CASE WHEN body = '' THEN 0 ELSE 2 + len(body) END AS n FROM sections)
        SELECT doc_id, section_idx, n AS content_length, n > 300 AS is_long, CASE WHEN n > 300 THEN 300 - t - CASE WHEN {_strip('body')} = '' THEN 0 ELSE 2 END END AS body_budget FROM r""",
    "pipe_tables": f"""{_LINES}, p AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS isle FROM fl WHERE NOT in_fence AND regexp_matches(line, '^[ \\t]*\\|.*\\|[ \\t]*$'))
        , r AS (SELECT doc_id, isle, min(line_no) AS first_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS raw FROM p GROUP BY doc_id, isle HAVING count(*) >= 2)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1 AS table_no, first_line, n_lines, raw FROM r""",
    "pipe_cells": f"""WITH t AS (SELECT p_partkey, string_split({_PIPE}, chr(10)) AS ls FROM part), l AS (SELECT p_partkey, unnest(range(len(ls))) AS n, ls FROM t)
        SELECT p_partkey, n AS line_no, array_to_string(list_transform(string_split(replace(ls[n + 1][2:-2], '\\|', chr(1)), '|'), lambda c: trim(replace(c, chr(1), '|'))), '¦') AS cells FROM l""",
    "pipe_grid": f"WITH {_PIPE_CELLS}, {_RECTANGLE}",
    "table_type": f"WITH {_PIPE_CELLS}, {_TOLD} SELECT p_partkey, kind AS table_type FROM kinds",
    **{kind: f"WITH {_PIPE_CELLS}, {_TOLD} SELECT p_partkey, text FROM told WHERE kind = '{kind}'" for kind in ("header_table", "cross_table", "kv_table")},
    "table_fallback": f"WITH {_PIPE_CELLS}, {_TOLD} SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN raw ELSE {_MARKED} END AS text FROM told",
    "html_tables": f"""WITH t AS (SELECT p_partkey, {_HTML} AS h FROM part) SELECT p_partkey, 0 AS n, h AS raw FROM t UNION ALL SELECT p_partkey, 1, upper(h) FROM t""",
    "html_grid": f"WITH {_HTML_CELLS}, {_RECTANGLE}",
    "html_linearize": f"WITH {_HTML_CELLS}, {_TOLD} SELECT p_partkey, 'before' || chr(10) || {_MARKED} || chr(10) || 'after' AS text FROM told",
    "sentences": f"""WITH s AS (SELECT doc_id, {_SENT.format('text')} AS ss FROM documents), n AS (SELECT doc_id, ss, unnest(range(len(ss))) AS k FROM s) SELECT doc_id, k AS sentence_no, ss[k + 1] AS sentence FROM n""",
    "recursive_split": "SELECT doc_id, true AS within, md5(regexp_replace(text, '\\s', '', 'g')) AS digest FROM documents",
    "pack_pieces": """WITH RECURSIVE p0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        p1 AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM p0), p2 AS (SELECT doc_id, ls[i + 1] AS t, (doc_id + i) % 3 = 0 AS atomic, i FROM p1),
        p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM p2 WHERE trim(t) <> ''),
        w AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS part, 0::BIGINT AS size, true AS closed FROM documents
              UNION ALL
              SELECT p.doc_id, p.k,
                     CASE WHEN w.k = 0 THEN 0 WHEN NOT w.closed AND NOT (p.atomic AND len(p.t) > 400) AND w.size + 2 + len(p.t) <= 400 THEN w.part ELSE w.part + 1 END,
                     CASE WHEN w.k > 0 AND NOT w.closed AND NOT (p.atomic AND len(p.t) > 400) AND w.size + 2 + len(p.t) <= 400 THEN w.size + 2 + len(p.t) ELSE len(p.t) END,
                     p.atomic AND len(p.t) > 400
              FROM w JOIN p ON p.doc_id = w.doc_id AND p.k = w.k + 1)
        SELECT w.doc_id, w.part AS part_no, string_agg(p.t, chr(10) || chr(10) ORDER BY p.k) AS text FROM w JOIN p ON p.doc_id = w.doc_id AND p.k = w.k GROUP BY w.doc_id, w.part""",
    "sentence_overlap": f"""WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, n AS k, ls[n + 1] AS c FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS n FROM d)),
        o AS (SELECT doc_id, k, c AS t FROM l WHERE k = 0
              UNION ALL
              SELECT doc_id, k, CASE WHEN len(c) > 400 THEN c WHEN n >= 2 AND len(two) + 1 + len(c) <= 400 THEN two || chr(10) || c
                                     WHEN n >= 1 AND len(one) + 1 + len(c) <= 400 THEN one || chr(10) || c ELSE c END
              FROM (SELECT doc_id, k, c, len(ss) AS n, ss[len(ss)] AS one, ss[len(ss) - 1] || ss[len(ss)] AS two
                    FROM (SELECT l.doc_id, l.k, l.c, {_SENT.format('o.t')} AS ss FROM o JOIN l ON l.doc_id = o.doc_id AND l.k = o.k + 1)))
        SELECT doc_id, k AS part_no, t AS text FROM o""",
    "merge_short": """WITH RECURSIVE d0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), d1 AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d0),
        d AS (SELECT doc_id, i, len(ls[i + 1]) AS n, (doc_id + i) // 9 AS key FROM d1), last AS (SELECT doc_id, max(i) AS i FROM d GROUP BY doc_id),
        m AS (SELECT doc_id, 0::BIGINT AS pos, 0::BIGINT AS a, 0::BIGINT AS size, key, NULL::BIGINT AS pa, NULL::BIGINT AS pb, NULL::BIGINT AS psize, NULL::BIGINT AS pkey, n AS now, NULL::BIGINT AS da, NULL::BIGINT AS db, NULL::BIGINT AS dsize
              FROM d WHERE i = 0
              UNION ALL
              SELECT m.doc_id, m.pos + 1, CASE WHEN fw THEN m.a ELSE d.i END, 0, CASE WHEN fw THEN m.key ELSE d.key END,
                     CASE WHEN fw THEN m.pa WHEN bk THEN m.pa ELSE m.a END, CASE WHEN fw THEN m.pb ELSE m.pos END,
                     CASE WHEN fw THEN m.psize WHEN bk THEN m.psize + 2 + m.now ELSE m.now END, CASE WHEN fw THEN m.pkey WHEN bk THEN m.pkey ELSE m.key END,
                     CASE WHEN fw THEN m.now + 2 + d.n ELSE d.n END,
                     CASE WHEN NOT fw AND NOT bk THEN m.pa END, CASE WHEN NOT fw AND NOT bk THEN m.pb END, CASE WHEN NOT fw AND NOT bk THEN m.psize END
              FROM (SELECT m0.*, d0.n AS dn, m0.now < 120 AND m0.key = d0.key AND m0.now + 2 + d0.n <= 420 AS fw,
                           m0.now < 120 AND m0.pkey IS NOT NULL AND m0.pkey = m0.key AND m0.psize + 2 + m0.now <= 420 AS bk
                    FROM m m0 JOIN d d0 ON d0.doc_id = m0.doc_id AND d0.i = m0.pos + 1) m
              JOIN d ON d.doc_id = m.doc_id AND d.i = m.pos + 1),
        e AS (SELECT m.*, now < 120 AND pkey IS NOT NULL AND pkey = key AND psize + 2 + now <= 420 AS bk FROM m JOIN last ON last.doc_id = m.doc_id AND last.i = m.pos),
        g AS (SELECT doc_id, da AS f, db AS l, dsize AS n FROM m WHERE da IS NOT NULL
              UNION ALL SELECT doc_id, pa, CASE WHEN bk THEN pos ELSE pb END, CASE WHEN bk THEN psize + 2 + now ELSE psize END FROM e WHERE pa IS NOT NULL
              UNION ALL SELECT doc_id, a, pos, now FROM e WHERE NOT bk)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1 AS group_no, f AS first_draft, l AS last_draft, n AS length FROM g""",
    "common_path": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a > b' || doc_id % 2 || ' > c0 > d' WHEN 1 THEN 'a > b' || doc_id % 2 || CASE WHEN doc_id % 5 = 0 THEN ' > c0' ELSE '' END
        ELSE 'a > b' || doc_id % 2 END AS common FROM documents""",
    "image_refs": f"{_REFS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, alt) - 1 AS ref_no, alt, dest AS raw_destination FROM rf",
    "image_dest": f"WITH {_DEST} SELECT page_id, t AS destination FROM d",
    "image_basename": f"""WITH {_DEST} SELECT page_id, CASE WHEN k IN (0, 1, 2) THEN lower(string_split(rtrim(string_split(string_split(t, '?')[1], '#')[1], '/'), '/')[-1]) WHEN k = 3 THEN page_id || '.jpg' WHEN k = 4 THEN lower(string_split(t, '/')[-1])
        WHEN k = 6 THEN '图' || page_id || '.png' WHEN k = 7 THEN lower(t) END AS image_key FROM d""",
    "url_authority": """WITH t AS (SELECT page_id, url, page_id % 9 AS k, string_split(string_split(url, '://')[2], '/')[1] AS host FROM pages)
        SELECT page_id, CASE k WHEN 1 THEN true WHEN 2 THEN true WHEN 4 THEN len(printf('%x', page_id)) > 4 WHEN 5 THEN true WHEN 6 THEN page_id % 2 = 1
                             ELSE k IN (0, 7) AND host SIMILAR TO '.*[\\[\\]].*' END AS is_bad FROM t""",
    "local_refs": "SELECT page_id, page_id % 8 NOT IN (0, 4, 5) AS is_local FROM pages",
    "image_join": f"{_REFS}, {_IMAGES} SELECT doc_id, k || '.PNG' AS image_name FROM three t WHERE EXISTS (SELECT 1 FROM rf WHERE rf.doc_id = t.doc_id AND rf.dest = 'images/' || t.k || '.png')",
    "unreferenced_images": f"{_REFS}, {_IMAGES} SELECT doc_id, k || '.PNG' AS image_name FROM three t WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.doc_id = t.doc_id AND rf.dest = 'images/' || t.k || '.png')",
    "first_ref": f"{_REFS} SELECT doc_id, regexp_extract(dest, '([^/]*)$', 1) AS image_key, min(line_no) AS line_no FROM rf GROUP BY ALL",
    "ref_heading": f"{_CONTEXT} SELECT doc_id, image_key, heading FROM cx",
    "image_context": f"{_CONTEXT} SELECT doc_id, image_key, pre_text, post_text FROM cx",
    "rewrite_refs": f"""WITH {_MD} SELECT doc_id, md5(regexp_replace(md, '!\\[([^\\]\\n]*)\\]\\(images/0\\.png\\)', '![\\1](http://store/b/' || doc_id || '/0.PNG)', 'g')) AS digest FROM md""",
    "alt_normalize": f"WITH {_IMAGES} SELECT doc_id, k || '.PNG' AS image_name, CASE WHEN k = 0 THEN '图片描述' ELSE 'seen ' || k || ' in ' || doc_id END AS alt FROM three",
    "summary_normalize": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a view' WHEN 2 THEN 'x ' || doc_id ELSE '图片描述' END AS summary FROM documents",
    "prompt_build": f"{_CONTEXT} SELECT doc_id, image_key, md5({_PROMPT}) AS digest FROM cx",
    "safe_dir": """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'c_ d' WHEN 1 THEN NULL WHEN 2 THEN n_name || '_x' ELSE '说明' || n_nationkey END AS directory FROM nation""",
    "object_url": "SELECT n_nationkey, 'http://h:9000/b%2Fc/knowledge/' || n_name || '%20%C3%A9~%2A%2B/' || n_nationkey || '.png' AS url FROM nation",
    "data_url": """SELECT n_nationkey, 'data:' || ['image/png', 'image/jpeg', NULL, 'image/webp'][n_nationkey % 4 + 1] || ';base64,' || base64(encode(repeat(n_name, 12))) AS data_url FROM nation""",
    "upload_stats": "SELECT doc_id, 3 AS n_images, 2 AS n_uploaded, 1 AS n_fallback FROM documents",
    "api_result_parse": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '# ' || n_name END AS md_content FROM nation",
}
ORACLES |= {f"sql_{name}": ORACLES[of] for name, of in {"sections": "sections", "blocks": "blocks", "recursive_split": "recursive_split", "linearized": "html_linearize", "chunks": "chunk_sections"}.items()}
ORACLES["sql_table_cells"] = f"WITH {_HTML_CELLS}, {_TOLD} SELECT p_partkey, i AS row_no, j AS column_no, v AS value, kind AS table_type FROM cells JOIN kinds USING (p_partkey)"

# The flagship: tables of the Markdown input as sentences, blocks, cuts at separators, packing, overlap and merging, each as a fold over a list.
_SEPARATORS = "['" + "', '".join(["\\n\\n", "\\n", "。", "！", "？", "；", ".", "!", "?", ";", "，", ",", " ", ""]).replace("\\n", "' || chr(10) || '") + "']"
_HEADER_LINE = "regexp_matches(line, '^\\| a \\| b[0-9]+ \\|$')"
_SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_FLAT = lambda x: f"trim({x}, {_SPACES})"
_LAST_SENTENCE = _SENT.format("acc[-1]").replace("lambda x:", "lambda y:").replace("trim(x,", "trim(y,").replace("x <> ''", "y <> ''") + "[-1]"


#: The cut of text blocks (doc_id, section_idx, budget, b, kind, t) at separators, coarse ones first; the rows that are done are pieces, in order of b and pos.
_CUTS = f"""rs AS (SELECT doc_id, section_idx, budget, b, []::BIGINT[] AS pos, t, 1::BIGINT AS k, kind <> 'text' AS done FROM b5 WHERE kind <> 'text' OR {_FLAT("t")} <> ''
       UNION ALL
       SELECT doc_id, section_idx, budget, b, list_append(pos, i), CASE WHEN long THEN t ELSE {_FLAT("t")} END, k, NOT long FROM (
         SELECT doc_id, section_idx, budget, b, pos, i, runs[i].t AS t, runs[i].long AS long, k + 1 AS k FROM (
           SELECT *, unnest(range(1, len(runs) + 1)) AS i FROM (
             SELECT doc_id, section_idx, budget, b, pos, k,
                    list_reduce(list_transform(pieces, lambda p: [{{'t': p, 'long': len(p) >= budget AND k < 14}}]),
                      lambda acc, x: CASE WHEN NOT acc[-1].long AND NOT x[1].long AND len(acc[-1].t) + len(x[1].t) <= budget
                                          THEN list_append(acc[:-2], {{'t': acc[-1].t || x[1].t, 'long': false}}) ELSE list_concat(acc, x) END) AS runs
             FROM (SELECT doc_id, section_idx, budget, b, pos, k, list_filter(CASE WHEN sep = '' THEN string_split(t, '') ELSE list_transform(string_split(t, sep), lambda p, j: CASE WHEN j = 1 THEN p ELSE sep || p END) END, lambda p: p <> '') AS pieces
                   FROM (SELECT *, {_SEPARATORS}[k] AS sep FROM (
                     SELECT doc_id, section_idx, budget, b, pos, t, list_filter(range(k, 15), lambda j: {_SEPARATORS}[j] = '' OR contains(t, {_SEPARATORS}[j]))[1] AS k FROM rs WHERE NOT done))) WHERE len(pieces) > 0)))
       WHERE long OR {_FLAT("t")} <> '')"""


def _chunks(longest: int, least: int) -> str:
    join = "acc[-1].n + 2 + x[1].n"
    close = f"""CASE WHEN len(acc) > 1 AND acc[-1].n < {least} AND acc[-2].k = acc[-1].k AND acc[-2].n + 2 + acc[-1].n <= {longest}
                     THEN list_append(acc[:-3], {{'a': acc[-2].a, 'b': acc[-1].b, 'n': acc[-2].n + 2 + acc[-1].n, 'k': acc[-2].k}}) ELSE acc END"""
    return f"""{_SECTIONS},
sx AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS section_idx FROM pa),
gt AS (SELECT *, coalesce(NOT in_fence AND {_HEADER_LINE} AND lead(line) OVER w = '|---|---|', false) AS is_table, lead(line, 2) OVER w AS l2 FROM gl WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
gd AS (SELECT *, coalesce(lag(is_table) OVER w, false) OR coalesce(lag(is_table, 2) OVER w, false) AS gone, regexp_extract(line, 'b([0-9]+)', 1) AS number, {_FLAT("regexp_extract(l2, '^\\| (.*) \\| [0-9]+ \\|$', 1)")} AS v
       FROM gt WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
gr AS (SELECT doc_id, g, line_no, opens, in_fence, CASE WHEN is_table THEN '【表格转译】' || chr(10) || '- 【' || CASE WHEN v = '' THEN '' ELSE 'a:' || v || '，' END || 'b' || number || ':' || number || '】' || chr(10) || '【表格转译结束】' ELSE line END AS line
       FROM gd WHERE NOT gone AND level = 0),
bo AS (SELECT doc_id, g, trim(string_agg(line, chr(10) ORDER BY line_no), chr(10)) AS body FROM gr GROUP BY doc_id, g),
ss AS (SELECT s.doc_id, s.section_idx, s.title, s.parent_title, s.path, {_FLAT("s.title")} AS head, coalesce(bo.body, '') AS body, sx.g
       FROM sections s JOIN sx USING (doc_id, section_idx) LEFT JOIN bo ON bo.doc_id = s.doc_id AND bo.g = sx.g),
sg AS (SELECT *, len(head) + CASE WHEN body = '' THEN 0 ELSE 2 + len(body) END > {longest} AS is_long, {longest} - len(head) - CASE WHEN {_FLAT("body")} = '' THEN 0 ELSE 2 END AS budget FROM ss),
b1 AS (SELECT gr.*, sg.section_idx, sg.budget, CASE WHEN in_fence THEN 'fenced_code' WHEN regexp_matches(line, '^\\s*!\\[[^\\]]*\\]\\([^\\n]+\\)\\s*$') THEN 'image'
              WHEN regexp_matches(line, '^\\s*\\[[^\\]]+\\]\\([^\\n]+\\)\\s*$') THEN 'link' ELSE 'text' END AS kind FROM gr JOIN sg USING (doc_id, g) WHERE is_long),
b2 AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind OR kind IN ('image', 'link') OR opens THEN 1 ELSE 0 END AS new FROM b1 WINDOW w AS (PARTITION BY doc_id, g ORDER BY line_no)),
b3 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, g ORDER BY line_no) AS b FROM b2),
b4 AS (SELECT doc_id, section_idx, budget, b, min(kind) AS kind, string_agg(line, chr(10) ORDER BY line_no) AS t, b = max(b) OVER (PARTITION BY doc_id, section_idx) AS last FROM b3 GROUP BY doc_id, section_idx, budget, b),
b5 AS (SELECT doc_id, section_idx, budget, b, kind, CASE WHEN kind = 'text' THEN trim(t, chr(10)) WHEN last THEN rtrim(t, chr(10)) ELSE t END AS t FROM b4),
{_CUTS},
pk AS (SELECT doc_id, section_idx, any_value(budget) AS budget, list([trim(t, chr(10))] ORDER BY b, pos) AS pieces FROM rs WHERE done AND {_FLAT("t")} <> '' GROUP BY doc_id, section_idx),
pp AS (SELECT doc_id, section_idx, budget, list_reduce(pieces, lambda acc, x: CASE WHEN len(acc[-1]) + 2 + len(x[1]) <= budget THEN list_append(acc[:-2], acc[-1] || chr(10) || chr(10) || x[1]) ELSE list_concat(acc, x) END) AS parts FROM pk),
po AS (SELECT doc_id, section_idx, list_reduce(list_transform(parts, lambda p: [p]), lambda acc, x: CASE WHEN len(x[1]) <= budget AND len({_LAST_SENTENCE}) + 1 + len(x[1]) <= budget
              THEN list_append(acc, {_LAST_SENTENCE} || chr(10) || x[1]) ELSE list_concat(acc, x) END) AS parts FROM pp),
dr AS (SELECT doc_id, section_idx, 0 AS part, body FROM sg WHERE NOT is_long UNION ALL SELECT doc_id, section_idx, part, parts[part] FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS part FROM po)),
dn AS (SELECT d.doc_id, d.section_idx, title, parent_title, path, trim(d.body, chr(10)) AS body, row_number() OVER (PARTITION BY d.doc_id ORDER BY d.section_idx, part) AS i,
              head || CASE WHEN trim(d.body, chr(10)) = '' THEN '' ELSE CASE WHEN head = '' THEN '' ELSE chr(10) || chr(10) END || trim(d.body, chr(10)) END AS content FROM dr d JOIN ss s ON s.doc_id = d.doc_id AND s.section_idx = d.section_idx),
ng AS (SELECT doc_id, list_reduce(list([{{'a': i, 'b': i, 'n': len(content), 'k': path[1]}}] ORDER BY i), lambda acc, x: CASE WHEN acc[-1].n < {least} AND acc[-1].k = x[1].k AND {join} <= {longest}
              THEN list_append(acc[:-2], {{'a': acc[-1].a, 'b': x[1].b, 'n': {join}, 'k': acc[-1].k}}) ELSE list_concat({close}, x) END) AS acc FROM dn GROUP BY doc_id),
nc AS (SELECT doc_id, {close} AS acc FROM ng),
gp AS (SELECT doc_id, c - 1 AS chunk_index, acc[c].a AS a, acc[c].b AS z FROM (SELECT *, unnest(range(1, len(acc) + 1)) AS c FROM nc)),
chunks AS (SELECT gp.doc_id, chunk_index, min_by(title, i) AS title, min_by(parent_title, i) AS parent_title,
              list_reduce(list(path ORDER BY i), lambda acc, p: acc[:coalesce(nullif(list_position(list_transform(range(1, least(len(acc), len(p)) + 1), lambda j: acc[j] <> p[j]), true), 0) - 1, least(len(acc), len(p)))]) AS path,
              list(title ORDER BY i) AS titles, list(section_idx ORDER BY i) AS indexes, string_agg(CASE WHEN {_FLAT("body")} <> '' THEN body END, chr(10) || chr(10) ORDER BY i) AS body, string_agg(content, chr(10) || chr(10) ORDER BY i) AS content
           FROM gp JOIN dn ON dn.doc_id = gp.doc_id AND dn.i BETWEEN a AND z GROUP BY gp.doc_id, chunk_index)"""


_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
ORACLES["chunks"] = f"""{_chunks(600, 150)}
    SELECT doc_id, chunk_index, 'doc' || doc_id AS file_title, title, parent_title, array_to_string(path, ' > ') AS heading_path, array_to_string({_DISTINCT.format("titles")}, ' > ') AS source_titles,
           array_to_string({_DISTINCT.format("indexes")}, ',') AS source_section_indexes, coalesce(body, '') AS body, content, len(content) AS char_count, '/in/' || source || '/doc' || doc_id || '.md' AS source_path
    FROM chunks JOIN documents USING (doc_id)"""
ORACLES["split_stats"] = f"""{_chunks(600, 150)}
    SELECT doc_id, count(*) AS n_chunks, sum(len(content))::BIGINT AS n_chars, len(list_distinct(flatten(list(indexes)))) AS n_sections, min(len(content)) AS min_chars, max(len(content)) AS max_chars FROM chunks GROUP BY doc_id"""
ORACLES["recursive_pieces"] = f"""WITH RECURSIVE b5 AS (SELECT doc_id, 0 AS section_idx, 120 AS budget, 0 AS b, 'text' AS kind, text AS t FROM documents), {_CUTS}
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS piece_no, t AS piece FROM rs WHERE done"""
