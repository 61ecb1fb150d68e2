"""The single-pass splitter on plain strings."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.config import SplitConfig, env_bool
from inkstone.errors import ConfigError, SplitError
from inkstone.plans import splitter as S
from inkstone.plans import html
from inkstone.plans.tables import CLOSE, FACTS, OPEN, linearized, pipe_grid, sentences, table_type


def titles(text):
    return [s.title for s in S.sections(text, "file")]


@given(st.one_of(st.integers(-5, 50), st.booleans(), st.floats(1, 9), st.none()), st.one_of(st.integers(-5, 50), st.booleans(), st.just("7")), st.one_of(st.integers(-3, 5), st.booleans()))
def test_config_takes_sizes_only(longest, least, overlap):
    whole = all(type(x) is int for x in (longest, least, overlap))
    if whole and 0 < least < longest and overlap >= 0:
        assert SplitConfig(longest, least, overlap).max_length == longest
    else:
        with pytest.raises(ConfigError):
            SplitConfig(longest, least, overlap)


def test_env_bool(monkeypatch):
    for value, want in (("1", True), (" YES ", True), ("on", True), ("0", False), ("", False)):
        monkeypatch.setenv("INKSTONE_X", value)
        assert env_bool("INKSTONE_X") is want
    monkeypatch.delenv("INKSTONE_X")
    assert env_bool("INKSTONE_X", True) is True


def test_normalized_drops_one_mark_and_carriage_returns():
    assert S.normalized("﻿a\r\nb\rc") == "a\nb\nc"
    assert S.normalized("﻿﻿a") == "﻿a"


@given(st.lists(st.integers(1, 6), max_size=25))
def test_paths_are_chains_of_nearest_higher_headings(levels):
    """Against looking back from each heading for the nearest one of a smaller level, again and again."""
    found = S.sections("\n".join(f"{'#' * level} h{n}" for n, level in enumerate(levels)), "file")
    assert [s.level for s in found] == levels
    for n, section in enumerate(found):
        chain = [n]
        for k in range(n - 1, -1, -1):
            if levels[k] < levels[chain[0]]:
                chain.insert(0, k)
        assert section.path == tuple(f"{'#' * levels[k]} h{k}" for k in chain)
        assert section.parent == section.path[-2 if len(chain) > 1 else -1]


def test_all_levels_and_orphans():
    found = S.sections("\n".join("#" * k + " x" for k in range(1, 7)), "file")
    assert [s.level for s in found] == [1, 2, 3, 4, 5, 6] and len(found[-1].path) == 6
    assert S.sections("### x\ny", "file")[0].parent == "### x"


def test_text_before_headings_and_empty_documents():
    assert S.sections("text\n# A", "file")[0] == S.Section(0, 0, "file", "file", ("file",), "text")
    assert S.sections("", "file") == [] and S.sections(" \n\t\n", "file") == []
    assert [(s.body, s.index) for s in S.sections("# A\n## B\ntext", "file")] == [("", 0), ("text", 1)]


#: Pieces of a document: lines, and which of them are headings.
_HASHES = st.integers(1, 9).map("#".__mul__)
_PLAIN = st.sampled_from(["words", "", "  - item", "a # b", "\t# tab", "#", "##  ", "\\# x"]).map(lambda x: ([x], []))
_ATX = st.tuples(st.integers(0, 6), _HASHES, st.sampled_from(["", " ", "\t", "  "]), st.sampled_from(["Rain", "Rain ##", "é 雨", "###"])).map(
    lambda x: ([line := " " * x[0] + x[1] + x[2] + x[3]], [line] if x[0] <= 3 and len(x[1]) <= 6 and x[2] else [])
)


@st.composite
def _fenced(draw):
    mark, size, indent = draw(st.sampled_from("`~")), draw(st.integers(3, 6)), draw(st.integers(0, 3))
    inside = draw(st.lists(st.sampled_from(["# hidden", "## hidden", "words", mark * (size - 1), ("~" if mark == "`" else "`") * 8, mark * size + " x"]), max_size=4))
    return [" " * indent + mark * size + draw(st.sampled_from(["", "py", " a b"])), *inside, mark * (size + draw(st.integers(0, 2))) + draw(st.sampled_from(["", "  "]))], []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(_PLAIN, _ATX, _fenced()), max_size=8), st.booleans())
def test_headings_are_found_outside_fences_only(pieces, unclosed):
    lines, heads = [line for piece, _ in pieces for line in piece], [line for _, found in pieces for line in found]
    hidden = ["~~~~~~~", "# hidden", "```"] if unclosed else []
    assert [t for t in titles("\n".join([*lines, *hidden])) if t != "file"] == heads


def test_a_backtick_in_the_info_opens_nothing():
    assert titles("```` x`y\n## seen") == ["file", "## seen"] and titles("~~~~ x`y\n## hidden") == ["file"]


def test_a_long_section_repeats_its_title():
    out = S.chunks("# T\n" + "One sentence here. " * 30, "f", "f.md", SplitConfig(60, 10, 0))
    assert len(out) > 1 and all(c["content"].startswith("# T\n\n") and c["char_count"] <= 60 for c in out)


def test_a_title_that_leaves_no_room():
    with pytest.raises(SplitError):
        S.chunks("# " + "t" * 18 + "\nbody", "f", "f.md", SplitConfig(20, 5, 0))


def test_overlap_reads_the_part_before_as_it_stands():
    parts = ["Rain fell; it stopped! Fog.", "Sun?", "Wind", "", "Y" * 9]
    assert S.overlapped(parts, 16, 2) == ["Rain fell; it stopped! Fog.", "Fog.\nSun?", "Fog.Sun?\nWind", "Sun?Wind\n", "Wind\n" + "Y" * 9]
    assert S.overlapped(parts, 16, 0) == parts and S.overlapped([], 16, 2) == []
    assert S.overlapped(["One. Two.", "Z" * 17], 16, 1) == ["One. Two.", "Z" * 17]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 30)), max_size=14), st.integers(1, 25), st.integers(26, 60))
def test_neighbours_partition_the_drafts(drafts, least, most):
    groups = S.neighbours(drafts, least, most)
    assert [i for first, last, _ in groups for i in range(first, last + 1)] == list(range(len(drafts)))
    for first, last, length in groups:
        part = drafts[first : last + 1]
        assert len({k for k, _ in part}) == 1 and length == sum(n for _, n in part) + 2 * (last - first)
        assert length <= most or first == last
    for (a, b, n), (c, _, m) in zip(groups, groups[1:], strict=False):
        # whoever is short found no room on either side
        if drafts[a][0] == drafts[c][0] and n + 2 + m <= most:
            assert m >= least and (n >= least or n + 2 + drafts[c][1] > most), (a, b, c)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "\n", "a", "bb\n", "c" * 12, "d d", "e" * 25]), st.booleans()), max_size=12), st.integers(1, 20))
def test_packing_is_greedy(pieces, budget):
    out = S.packed(pieces, budget)
    texts = [t.strip("\n") for t, _ in pieces if t.strip()]
    assert "\n\n".join(out) == "\n\n".join(texts)
    assert all(len(p) <= budget or p in texts for p in out)
    for p, q in zip(out, out[1:], strict=False):
        assert len(p) + 2 + len(q.split("\n\n")[0]) > budget


def test_blocks_and_oversize_fences():
    assert S.blocks("text\n![a](b)\n[c](d)") == [("text", "text", False), ("![a](b)", "image", True), ("[c](d)", "link", True)]
    out = S.chunks("# T\n```\n" + "x" * 70 + "\n```", "f", "f.md", SplitConfig(45, 10, 0))
    assert len(out) == 1 and out[0]["char_count"] > 45


def test_merging():
    out = S.chunks("# A\n## x\nshort\n## y\nshort\n# B\n## z\nshort", "f", "f.md", SplitConfig(100, 45, 0))
    assert [c["source_section_indexes"] for c in out] == [[0, 1, 2], [3, 4]]
    assert out[0]["heading_path"] == ["# A"] and out[0]["source_titles"] == ["# A", "## x", "## y"]


def test_a_blank_long_body_disappears():
    assert S.chunks("# T\n" + " " * 3000, "f", "f.md", SplitConfig()) == []


def test_odd_characters():
    out = S.chunks("# 😀 b\r\ntext x y", "f", "f.md", SplitConfig())
    assert out[0]["title"] == "# 😀 b" and out[0]["char_count"] == len(out[0]["content"])


@st.composite
def _tiled(draw):
    """A rectangle of cells with spans, as HTML and filled in."""
    height, width = draw(st.integers(1, 5)), draw(st.integers(1, 5))
    grid: list[list] = [[None] * width for _ in range(height)]
    out = []
    for i in range(height):
        row = []
        for j in range(width):
            if grid[i][j] is not None:
                continue
            free = next((k for k in range(j, width) if grid[i][k] is not None), width)
            across, down = draw(st.integers(1, free - j)), draw(st.integers(1, height - i))
            text, shown = draw(st.sampled_from([("rain", "rain"), ("a &lt; b", "a < b"), ("<b>x</b><br>y", "x y"), (" ", ""), ("<!-- no -->z", "z"), ("<i title='a>b'>q</i>", "q")]))
            for a in range(i, i + down):
                grid[a][j : j + across] = [shown] * across
            quote = draw(st.sampled_from(["", "'", '"']))
            row.append(f"<td rowspan={quote}{down}{quote} colspan={quote}{across}{quote}>{text}</td>")
        out.append(f"<tr>{''.join(row)}</tr>")
    return f"<TABLE id=t>{''.join(out)}</TABLE >", grid


@settings(max_examples=150, deadline=None)
@given(_tiled())
def test_spans_fill_the_rectangle(tiled):
    raw, grid = tiled
    assert html.grid(raw) == (grid, False)
    text = sentences(grid, table_type(grid, False))
    assert linearized(f"x {raw} y") == (f"x {OPEN}\n{text}\n{CLOSE} y" if text else f"x {raw} y")


def test_kinds_of_tables():
    for grid, header, kind in (([], True, "unknown"), ([[]], True, "unknown"), ([["k", "v"]], False, "kv_table"), ([["", "v"]], True, "header_table"), ([[" ", "x", "y"]], True, "cross_table"), ([["x", "", "y"]], False, "header_table"), ([["x"]], False, "header_table")):
        assert table_type(grid, header) == kind
    assert sentences([["Sky", " "], ["wet", "3"], ["", " "]], "header_table") == "- 【Sky:wet，第2列:3】"
    assert sentences([["Sky", ""], ["", ""]], "header_table") == "- 【Sky，第2列】" and sentences([["", ""]], "header_table") == ""
    assert sentences([["", "dry", ""], ["hill", "1", "2"], ["", "", "4"]], "cross_table") == "- hill的dry标准为1\n- hill的未命名列标准为2\n- 第2行的未命名列标准为4"
    assert sentences([["hue", " red "], ["size", ""]], "kv_table") == "- hue：red" and sentences([["x"]], "unknown") == "" and set(FACTS) == {"header_table", "cross_table", "kv_table"}


_MANY = 100_000


@pytest.mark.parametrize(
    "text",
    ["<table>" * _MANY, "<table>" * _MANY + "</table>", "<table " * _MANY + "</table>", "<table><tr>" + "<td><b>" * _MANY + "</table>", "<table>" + "</b>" * _MANY + "</table>", "<table>" + "<!--" * _MANY + "</table>", '<table><td a="' * _MANY + "</table>", "<table><tr><td colspan=1000000000>x</td></tr></table>", "<table>" + "<tr><td rowspan=999999999>x</td></tr>" * 1000 + "</table>"],
    ids=["open", "one close", "no end", "deep", "closing", "comments", "quotes", "wide", "tall"],
)
def test_bad_pages_take_no_time_and_stay(text):
    began = time.process_time()
    assert linearized(text) == text
    assert time.process_time() - began < 1.5


@pytest.mark.parametrize("bad", ["rowspan='bad'", "rowspan=0", "rowspan=3", "colspan=-1"])
def test_bad_html_tables_stay(bad):
    raw = f"<table><tr><td {bad}>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
    assert linearized(raw) == raw
    nested = "<table><tr><td><table><tr><td>x</td><td>y</td></tr></table></td></tr></table>"
    assert linearized(nested) == nested


def test_pipe_tables():
    assert linearized("| a | b |\n|---|---|\n| 1 | 2 |\nafter") == f"{OPEN}\n- 【a:1，b:2】\n{CLOSE}\nafter"
    assert linearized("| k | v |\n| k2 | v2 |") == f"{OPEN}\n- k：v\n- k2：v2\n{CLOSE}"
    assert linearized("| alone |\nx") == "| alone |\nx"
    fenced = "```\n| a | b |\n|---|---|\n| 1 | 2 |\n```"
    assert linearized(fenced) == fenced and linearized("```\n| a |\n| b |") == "```\n| a |\n| b |"
    grid, ruled = pipe_grid(["| a |  | c |", "|---|---|", "| 1 | 2 | 3 |"])
    assert not ruled and grid[1] == ["---", "---", ""] and table_type(grid, ruled) == "header_table"


def test_a_pipe_table_of_any_length():
    text = "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 20000
    assert linearized(text).count("【a:1，b:2】") == 20000


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。.\n,!", max_size=400), st.integers(1, 40))
def test_recursive_split_keeps_all_but_white_space(text, size):
    out = S.recursive_split(text, size)
    assert all(len(x) <= size for x in out)
    assert re.sub(r"\s", "", "".join(out)) == re.sub(r"\s", "", text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B", "text one. two.", "", "```", "| a | b |", "|---|---|", "### C  ", "long " * 20]), max_size=30))
def test_chunk_invariants(lines):
    config = SplitConfig(80, 30, 1)
    out = S.chunks("\n".join(lines), "f", "f.md", config)
    assert [c["chunk_index"] for c in out] == list(range(len(out)))
    assert all(c["char_count"] == len(c["content"]) and c["content"] for c in out)
    seen = [i for c in out for i in c["source_section_indexes"]]
    assert seen == sorted(seen)
