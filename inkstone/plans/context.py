"""What stands around the images of one document: plain Python, linear in its lines but for the context that is taken."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

# Formats of the input.
IMAGE = re.compile(r"!\[([^\]\n]*)\]\(\s*([^)\n]+?)\s*\)")
HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s|\Z)")


def contexts(text: str, places: list[int], limit: int) -> list[tuple[str, str, str]]:
    """(heading above, text before, text after) of the lines at places.

    Context is whole paragraphs between the nearest headings, nearest first while limit characters hold them (the
    first one always, none if limit is 0); blank lines and lines with images end a paragraph.
    """
    lines = text.splitlines()
    heads = [i for i, line in enumerate(lines) if HEADING.match(line)]
    is_head = set(heads)
    begins, ends = [], []
    for i, line in enumerate(lines):
        if not line.strip() or i in is_head or IMAGE.search(line):
            continue
        if ends and ends[-1] == i:
            ends[-1] = i + 1
        else:
            begins.append(i)
            ends.append(i + 1)

    def taken(numbers: range) -> list[str]:
        found, size = [], 0
        for n in numbers if limit > 0 else ():
            paragraph = "\n".join(lines[begins[n] : ends[n]])
            size += len(paragraph)
            if found and size > limit:
                break
            found.append(paragraph)
        return found

    out = []
    for at in places:
        above = bisect_left(heads, at)
        low = heads[above - 1] if above else -1
        below = bisect_right(heads, at)
        high = heads[below] if below < len(heads) else len(lines)
        before = range(bisect_right(ends, at) - 1, bisect_left(begins, low + 1) - 1, -1)
        after = range(bisect_right(begins, at), bisect_left(begins, high))
        out.append((lines[low].strip() if above else "", "\n\n".join(reversed(taken(before))), "\n\n".join(taken(after))))
    return out
