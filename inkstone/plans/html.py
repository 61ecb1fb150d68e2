"""HTML tables in a text: found, read tag by tag, and laid out as intervals of columns. Plain Python on one text, O(n).

No step looks back or begins again: each search for an end goes on from where the last one stopped, open tags are counted
by name, and a cell that spans a million columns is one interval. A rectangle is only filled in if it has at most MOST_CELLS.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

# Formats of the input.
TABLE_OPENS = re.compile(r"<table\b", re.I)
TABLE_CLOSES = re.compile(r"</table\s*>", re.I)
_TAG = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
_STOP = re.compile("[\"'>]")
#: Tags without content, and those whose content is no text.
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
NO_TEXT = {name: re.compile(f"</{name}", re.I) for name in ("script", "style")}

#: Cells of the largest rectangle that is filled in; a larger table stays as it is.
MOST_CELLS = 1 << 20


def tables(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of each HTML table: an opening tag up to the nearest closing one; a tag without one opens no table."""
    closes, end = TABLE_CLOSES.finditer(text), 0
    close = next(closes, None)
    for tag in TABLE_OPENS.finditer(text) if close else ():
        if tag.start() < end:
            continue
        stop = text.find(">", tag.end())
        while close and close.start() <= stop:
            close = next(closes, None)
        if stop < 0 or not close:
            return
        end = close.end()
        yield tag.start(), end


@dataclass
class Cell:
    """A cell: its texts, whether it is a header, and its spans as written."""

    header: bool
    down: str
    across: str
    texts: list[str] = field(default_factory=list)


def _end_of_tag(html: str, at: int, no_more: set[str]) -> int:
    """The place after the > that ends a tag, outside quotes; -1 if there is none. no_more: quotes that don't occur any more."""
    end = html.find(">", at)
    if end < 0 or not (html.find('"', at, end) >= 0 or html.find("'", at, end) >= 0):
        return end + 1 if end >= 0 else -1
    while stop := _STOP.search(html, at):
        at = stop.end()
        if stop[0] == ">":
            return at
        end = -1 if stop[0] in no_more else html.find(stop[0], at)
        if end < 0:
            no_more.add(stop[0])
        else:
            at = end + 1
    return -1


def tags(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """('text', text, {}), ('open', name, attributes) and ('close', name, {}), in order; comments and declarations are left out."""
    at, no_more = 0, set()
    while (low := html.find("<", at)) >= 0:
        if low > at:
            yield "text", unescape(html[at:low]), {}
        tag = _TAG.match(html, low + 1)
        if html.startswith("<!--", low):
            end = html.find("-->", low + 4)
            at = end + 3 if end >= 0 else len(html)
        elif tag or html[low + 1 : low + 2] in ("!", "?"):
            end = _end_of_tag(html, tag.end() if tag else low + 2, no_more)
            if end < 0:  # no tag ends after here
                at = low
                break
            at = end
            if not tag:
                continue
            name = tag[0].lower()
            if name[0] == "/":
                yield "close", name[1:], {}
                continue
            inside = html[tag.end() : end - 1]
            yield "open", name, {k.lower(): unescape(x or y or z) for k, x, y, z in _ATTRIBUTE.findall(inside)} if inside else {}
            if inside.endswith("/"):
                yield "close", name, {}
            elif name in NO_TEXT:
                over = NO_TEXT[name].search(html, end)
                at = over.start() if over else len(html)
        else:
            yield "text", "<", {}
            at = low + 1
    if at < len(html):
        yield "text", unescape(html[at:]), {}


def rows_of(html: str) -> list[list[Cell]]:
    """The rows of the only table in html, with the cells that stand in them directly; ValueError without a table or with one inside another."""
    rows: list[list[Cell]] = []
    path: list[str] = []
    around: Counter[str] = Counter()
    tables = 0
    for kind, value, attributes in tags(html):
        if kind == "open":
            tables += value == "table"
            if tables > 1:
                raise ValueError("a table inside a table")
            if value == "tr":
                rows.append([])
            elif value in ("td", "th") and path and path[-1] == "tr":
                rows[-1].append(Cell(value == "th", attributes.get("rowspan", "1"), attributes.get("colspan", "1")))
            if value not in EMPTY:
                path.append(value)
                around[value] += 1
        elif kind == "close":
            while around[value]:
                inner = path.pop()
                around[inner] -= 1
                if inner == value:
                    break
        elif (around["td"] or around["th"]) and rows and rows[-1] and (bare := value.strip()):
            rows[-1][-1].texts.append(bare)
    if not tables:
        raise ValueError("no table")
    return rows


def span(written: str) -> int:
    n = int(written)
    if n <= 0:
        raise ValueError("a span must be positive")
    return n


@dataclass(frozen=True)
class Interval:
    """Columns begin to end of a row that one cell covers, down to the row before until."""

    begin: int
    end: int
    until: int
    text: str


def laid_out(rows: list[list[Cell]]) -> list[list[Interval]]:
    """For each row the intervals that cells cover, from left to right.

    A cell begins at the first free column after the cell before it. ValueError for bad spans, spans beyond the last row, cells that overlap and
    tables of more than MOST_CELLS.
    """
    out: list[list[Interval]] = []
    above: list[Interval] = []
    covered = width = 0
    for i, cells in enumerate(rows):
        row: list[Interval] = []
        hanging = iter([x for x in above if x.until > i])
        next_ = next(hanging, None)
        column = 0
        for cell in cells:
            down, across = span(cell.down), span(cell.across)
            while next_ and next_.begin <= column:
                column = max(column, next_.end)
                row.append(next_)
                next_ = next(hanging, None)
            if i + down > len(rows):
                raise ValueError("a span leaves the table")
            if next_ and next_.begin < column + across:
                raise ValueError("cells overlap")
            row.append(Interval(column, column + across, i + down, " ".join(cell.texts)))
            column += across
        row += [next_, *hanging] if next_ else []
        covered += sum(x.end - x.begin for x in row)
        width = max([width, *(x.end for x in row[-1:])])
        if covered > MOST_CELLS or width * len(rows) > MOST_CELLS:
            raise ValueError("too large a table")
        out.append(row)
        above = row
    return out


def grid(html: str) -> tuple[list[list[str]], bool]:
    """The rectangle that an HTML table covers, every cell repeated over its spans, what no cell covers empty; and whether its first row has headers."""
    rows = rows_of(html)
    intervals = laid_out(rows)
    width = max((row[-1].end for row in intervals if row), default=0)
    filled = [[""] * width for _ in rows]
    for line, row in zip(filled, intervals, strict=True):
        for x in row:
            line[x.begin : x.end] = [x.text] * (x.end - x.begin)
    return filled, any(cell.header for row in rows[:1] for cell in row)
