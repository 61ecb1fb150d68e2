"""Removal of repeated passages by sorting suffixes.

Every byte covered by a LENGTH-byte string that also starts earlier is removed. Two suffixes matter to
each other if their first LENGTH bytes are equal, so these are what is compared.

1. Runs. Of the GRAM-byte strings inside a suffix's first LENGTH bytes, the one with the least hash is its anchor:
   equal suffixes have equal anchors at the same distance. Neighbouring suffixes with one anchor travel together as a
   run, with the bytes of all of them.
2. Partition. Sampled splitters range-partition the runs by the leading bytes of their anchors; a range that is
   larger than a bucket is cut by a hash of the whole anchor. Equal suffixes have the same anchor, so they never lie
   on two sides of a boundary, and no bucket has anything to compare with the next one. An anchor that is more
   common than a bucket can hold (a licence's first words) has its suffixes dealt one by one, by all their bytes.
3. Sort. Each bucket sorts its runs by the bytes of their anchors; an anchor that stands alone matches nothing. Runs
   that share one are sorted by their first and last suffixes, and of equal runs all but the earliest are repeats.
   The suffixes of the other runs are sorted by their own bytes, and of equal ones all but the earliest are repeats.
   All three are a multikey quicksort whose keys are eight bytes: groups that are equal so far are sorted by the next
   key, until they are alone or equal in all LENGTH bytes. No hash decides on equality.
4. Removal. The repeats of a document are united and its bytes outside them are kept.

Each batch of documents sorts its own suffixes first, by the same function, and sends only those on that are the
earliest in it, so what thousands of copies share doesn't pile up in one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import Texts, hash_of, mix, powers, slices
from .filters import held, key_filter
from .packing import ROWS, SCHEMA, by_part, pack, rows, unpack
from .scratch import keep

LENGTH, GRAM, LEAD = 100, 32, 16
#: Text bytes that are sorted together before they are sent on; text bytes behind one bucket of runs, and of documents.
PACK_BYTES, SORT_BYTES, TEXT_BYTES = 4 << 20, 4 << 20, 32 << 20
#: Suffixes that are sorted at a time, but for those of one anchor at one distance.
SORT_SUFFIXES = 1 << 18
#: Ranges of leading bytes at most, and text bytes of the documents that are sampled for their boundaries, about.
RANGES, SAMPLE_BYTES = 4096, 16 << 20

_LAST = np.iinfo(np.int64).max  # stands for no doc_id
_RUNS, _SPANS, _TEXTS = 0, 1, 2
_SPAN_KINDS = ("<u4", "<u4", "<u4", "<i8", "p3")
_RUN_KINDS = ("<u4", "<u1", "<u4", "<u1", "<u1", "<i8", "p3")
_RAW = 4  # the field of bytes


def anchored(texts: Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one anchor: hash of the anchor, document, place of the first suffix in the bytes, further suffixes, distance of the anchor."""
    n = len(texts.data)
    if n < length:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    prefix = texts.prefix()
    grams = mix((prefix[gram:] - prefix[:-gram]) * powers(n + 1, True)[: n - gram + 1])
    bits = np.uint64(max(22, n.bit_length()))
    # the place in the low bits makes the leftmost of equal grams the least
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    have, want = 1, length - gram + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), texts.lengths())
    inside = owner[: n - length + 1] == owner[length - 1 :]
    edge = np.ones(len(anchor) + 1, bool)
    edge[1:-1] = (anchor[1:] != anchor[:-1]) | (owner[1 : n - length + 1] != owner[: n - length]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(edge)
    first, last = at[:-1], at[1:] - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    where = anchor[first]
    return grams[where], owner[first].astype(np.int64), first, last - first, where - first


# The sort.


def multikey(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of depth bytes (8 at least) at places of data, and for each place in it the first place of an equal string.

    A multikey quicksort with keys of eight bytes: all groups that are equal so far are sorted by their next key at once.
    From the third key on a group is first compared with its first string as a whole, and is done if all are equal to it.
    """
    words = np.ndarray((max(0, len(data) - 7),), ">u8", np.ascontiguousarray(data), strides=(1,))
    order, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    open_ = np.arange(len(at)) if len(at) > 1 else np.zeros(0, np.int64)
    steps = [min(d, depth - 8) for d in range(0, depth, 8)]
    for n, d in enumerate(steps):
        if not len(open_):
            break
        key, g = words[at[order[open_]] + d].astype(np.uint64), group[open_]
        s = np.lexsort((key, g))
        order[open_], key = order[open_][s], key[s]
        new = np.ones(len(open_), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
        if n >= 2 and len(open_):
            mine, lead = at[order[open_]], at[order[group[open_]]]
            same = np.ones(len(open_), bool)
            for k in steps[n + 1 :]:
                same &= words[mine + k] == words[lead + k]
            unlike = np.zeros(len(at), bool)
            unlike[group[open_][~same]] = True
            open_ = open_[unlike[group[open_]]]
    return order, group


def repeats(data: np.ndarray, first: np.ndarray, more: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run and number in it of each suffix that equals an earlier one, by sorting all suffixes of the runs.

    first: place of each run's first suffix in data; doc, start: which suffix is earlier. One start of one document is not earlier than itself.
    """
    n = more + 1
    run = np.repeat(np.arange(len(n), dtype=np.int32), n)
    k = (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    again, order, _ = later(*multikey(data, first[run] + k, LENGTH), doc[run], start[run] + k)
    return run[order[again]].astype(np.int64), k[order[again]].astype(np.int64)


def later(order: np.ndarray, group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted strings that equal others (order, by group and then doc and start) which are later than the first of their group, that order, and which are a first one."""
    several = np.zeros(len(order), bool)
    several[1:] = group[1:] == group[:-1]
    several[:-1] |= several[1:]
    order, group = order[several], group[several]
    when = np.lexsort((start[order], doc[order], group))
    order, group = order[when], group[when]
    new = np.ones(len(order), bool)
    new[1:] = group[1:] != group[:-1]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return (doc[order] != doc[lead]) | (start[order] != start[lead]), order, new


def repeated_runs(data: np.ndarray, first: np.ndarray, more: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which runs equal an earlier one as a whole, so that all their suffixes do.

    A run is at most two suffixes long, so it is its first and its last one: the runs are sorted by the one and then by the other.
    """
    one, group = multikey(data, first, LENGTH)
    head, tail = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
    head[one] = group
    other, group = multikey(data, first + more, LENGTH)
    tail[other] = group
    order = np.lexsort((more, tail, head))
    new = np.ones(len(order), bool)
    for x in (head, tail, more):
        new[1:] &= x[order][1:] == x[order][:-1]
    new[1:] = ~new[1:]
    again, order, _ = later(order, np.flatnonzero(new)[np.cumsum(new) - 1], doc, start)
    out = np.zeros(len(first), bool)
    out[order[again]] = True
    return out


def repeats_by_anchor(data: np.ndarray, first: np.ndarray, more: np.ndarray, anchor: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as stretches of neighbours (run, first number in it, further ones), in order, sorting the runs by their anchors, those that share one as wholes, and only then the suffixes of those that differ."""
    order, group = multikey(data, first + anchor, GRAM)
    shared = np.zeros(len(order), bool)
    shared[1:] = group[1:] == group[:-1]
    shared[:-1] |= shared[1:]
    order, group = order[shared], group[shared]
    ends = np.cumsum(more[order] + 1)
    cuts = np.append(np.flatnonzero(np.diff(group)) + 1, len(order)) if len(order) else np.zeros(0, np.int64)
    found, a = [], 0
    while a < len(order):
        # whole groups of equal anchors, at least one
        reach = np.searchsorted(ends, (ends[a - 1] if a else 0) + SORT_SUFFIXES, "right")
        b = int(cuts[max(np.searchsorted(cuts, reach, "right") - 1, np.searchsorted(cuts, a, "right"))])
        o = order[a:b]
        whole = repeated_runs(data, first[o], more[o], doc[o], start[o])
        found.append((o[whole], np.zeros(int(whole.sum()), np.int64), more[o[whole]]))
        o = o[~whole]
        # equal suffixes have their anchors at one distance: a large group goes by distances, a few at a time
        fits = (more[o] + 1).sum() <= SORT_SUFFIXES
        width = LENGTH if fits else max(1, SORT_SUFFIXES // len(o))
        for near in range(0, LENGTH - GRAM + 1, width):
            reach = near + width
            k0, k1 = np.maximum(0, anchor[o] - reach + 1), np.minimum(more[o], anchor[o] - near)
            some = np.flatnonzero(k0 <= k1)
            these, k0, k1 = o[some], k0[some], k1[some]
            run, k = repeats(data, first[these] + k0, k1 - k0, doc[these], start[these] + k0)
            k = k + k0[run]
            when = np.lexsort((k, run))
            run, low, further = stretches(run[when], k[when])
            found.append((these[run], low, further))
        a = b
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    run, low, further = (np.concatenate(x) for x in zip(*found, strict=True))
    when = np.lexsort((low, run))
    run, low, further = run[when], low[when], further[when]
    # stretches that were cut between distances
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (low[1:] != low[:-1] + further[:-1] + 1)
    at = np.flatnonzero(new)
    ends = low + further
    last = np.append(at[1:], len(run)) - 1 if len(at) else at
    return run[at], low[at], ends[last] - low[at]


def between(run: np.ndarray, low: np.ndarray, further: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stretches (in order) leave of the runs that they are in, as stretches."""
    new = np.ones(len(run), bool)
    new[1:] = run[1:] != run[:-1]
    last = np.append(new[1:], True)[: len(run)]
    after = low + further + 1
    begin = np.where(new, 0, np.append(0, after[:-1])[: len(run)])
    ahead, behind = low > begin, last & (after <= more[run])
    run_, low_ = np.append(run[ahead], run[behind]), np.append(begin[ahead], after[behind])
    return run_, low_, np.append((low - begin)[ahead], (more[run] - after + 1)[behind]) - 1


def stretches(run: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes (run, number) as stretches of neighbours: run, first number, further ones."""
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (k[1:] != k[:-1] + 1)
    at = np.flatnonzero(new)
    return run[at], k[at], np.diff(np.append(at, len(run))) - 1


# Documents and packed rows.


def _doc_part(ids: np.ndarray, tags: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tags) >> np.uint64(33)).astype(np.int64) % parts


def _docs_of(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (those missing: _LAST), tags, and whether the id is missing."""
    ids = batch.column("doc_id")
    none = np.asarray(ids.is_null())
    return np.array(ids.fill_null(_LAST), np.int64), np.asarray(batch.column("tag")).astype(np.uint64), none


def _ranked(ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document its rank in the order that decides which string is earlier, and the ids and tags of the ranks; rows of one id and text are one document."""
    order = np.lexsort((tags, ids))
    ids, tags = ids[order], tags[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, ids[new], tags[new]


def _dictionary(doc: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, tuple, tuple]:
    """doc as numbers in a list of the documents that occur, and that list (ids as differences, tags)."""
    own, local = np.unique(doc, return_inverse=True)
    return local, ("<i8", np.diff(ids[own], prepend=0)), ("p3", tags[own])


def _spans(doc: np.ndarray, start: np.ndarray, more: np.ndarray, ids: np.ndarray, tags: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Packed rows, by the documents' part, of repeated suffixes: document, first suffix, further suffixes."""
    to = _doc_part(ids, tags, parts)[doc]
    order = np.lexsort((start, doc, to))
    doc, start, more, to = doc[order], start[order], more[order], to[order]
    out = []
    for p, s in by_part(to, parts):
        local, *named = _dictionary(doc[s], ids, tags)
        out.append((p, _SPANS, pack(("<u4", start[s]), ("<u4", more[s]), ("<u4", local), *named)))
    return out


def _gathered(blobs: list[bytes], kinds: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The fields of packed rows, their documents (third field) as ranks, and the ids and tags of the ranks."""
    got = [unpack(b, *kinds) for b in blobs]
    blobs.clear()
    rank, ids, tags = _ranked(np.concatenate([np.cumsum(x[-2]) for x in got]), np.concatenate([x[-1] for x in got]))
    base = np.cumsum([0, *(len(x[-1]) for x in got)])
    doc = np.concatenate([x[2].astype(np.int64) + b for x, b in zip(got, base, strict=False)])
    fields = []
    for k in range(len(kinds) - 2):
        # bytes get a few more behind them, for keys of eight bytes at their end
        fields.append(np.concatenate([*(x[k] for x in got), np.zeros(8, np.uint8)] if k == _RAW else [x[k] for x in got]))
        for x in got:
            x[k] = None
    return fields, rank[doc], ids, tags


def _bytes_of(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return data[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The leading bytes at places, as values that sort like the bytes."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(LEAD)]).view(f"S{LEAD}").ravel()


def _sample(rate: int):
    """Leading bytes and hashes of the anchors of one in rate documents; of one over 1 MB in proportion fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, _ = _docs_of(batch)
            chosen = mix(mix(ids.view(np.uint64)) + tags) % np.uint64(rate) == 0
            for texts in slices(batch.column("text").filter(pa.array(chosen))):
                gram, _, first, _, distance = anchored(texts)
                step = 1 + (len(texts.data) >> 21)
                keys = _leads(texts.data, (first + distance)[::step])
                yield pa.RecordBatch.from_pydict({"lead": pa.array(keys.tolist(), pa.binary()), "gram": pa.array(gram[::step].view(np.int64))})

    return run


class Plan:
    """Where a run goes: a range of leading bytes, cut by the hash of the anchor; suffixes of hot anchors by all their bytes."""

    def __init__(self, splitters: np.ndarray, cuts: int, hot: np.ndarray):
        self.splitters, self.cuts, self.hot = splitters, cuts, hot
        self.parts = (len(splitters) + 1) * cuts

    def part(self, lead: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.splitters, lead, "right") * self.cuts + (gram >> np.uint64(33)).astype(np.int64) % self.cuts

    def is_hot(self, gram: np.ndarray) -> np.ndarray:
        return np.isin(gram.view(np.int64), self.hot) if len(self.hot) else np.zeros(len(gram), bool)


def planned(rows_in: DataFrame, size: int) -> Plan:
    """A plan from a sample of about SAMPLE_BYTES of text, whatever the size of the corpus."""
    want = max(24, -(-size // SORT_BYTES))
    rate = max(1, -(-size // SAMPLE_BYTES))
    sample = rows_in.mapInArrow(_sample(rate), "lead binary, gram long").toArrow()  # about SAMPLE_BYTES / 30 rows
    leads, grams = np.sort(np.array(sample.column("lead").to_pylist(), f"S{LEAD}")), np.asarray(sample.column("gram"))
    ranges = min(want, RANGES)
    splitters = np.unique(leads[np.arange(1, ranges) * len(leads) // ranges]) if len(leads) else leads
    own, n = np.unique(grams, return_counts=True)
    return Plan(splitters, -(-want // ranges), own[n >= max(4, len(grams) / want)])


def _runs(plan: Plan, doc_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names: list[tuple] = []

        def flush() -> pa.RecordBatch:
            data = np.concatenate([*(x[0] for x in held), np.zeros(8, np.uint8)])
            gram, doc, first, more, anchor, start = (np.concatenate([x[k] for x in held]) for k in range(1, 7))
            rank, ids, tags = _ranked(*(np.concatenate([x[k] for x in names]) for k in range(2)))
            doc = rank[doc]
            r, low, further = repeats_by_anchor(data, first, more, anchor, doc, start)
            out = [(plan.parts + p, kind, blob) for p, kind, blob in _spans(doc[r], start[r] + low, further, ids, tags, doc_parts)]
            # what is left of the runs
            whole = np.ones(len(first), bool)
            whole[r] = False
            whole = np.flatnonzero(whole)
            r, low, further = between(r, low, further, more)
            r, low, further = np.append(whole, r), np.append(np.zeros(len(whole), np.int64), low), np.append(more[whole], further)
            to = plan.part(_leads(data, first[r] + anchor[r]), gram[r])
            if (hot := plan.is_hot(gram[r])).any():
                n = further[hot] + 1
                each, number = np.repeat(r[hot], n), np.repeat(low[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = first[each] + number
                deal = (hash_of(Texts(data, np.array([0, len(data)])).prefix(), at, at + LENGTH) >> np.uint64(33)).astype(np.int64) % plan.parts
                r, low, further, to = (np.append(x[~hot], y) for x, y in ((r, each), (low, number), (further, np.zeros(len(each), np.int64)), (to, deal)))
            order = np.argsort(to, kind="stable")
            r, low, further, to = r[order], low[order], further[order], to[order]
            for p, s in by_part(to, plan.parts):
                o = r[s]
                local, *named = _dictionary(doc[o], ids, tags)
                raw = _bytes_of(data, first[o] + low[s], further[s] + LENGTH)
                out.append((p, _RUNS, pack(("<u4", start[o] + low[s]), ("<u1", further[s]), ("<u4", local), ("<u1", anchor[o] - low[s]), ("<u1", raw), *named)))
            return rows(out)

        size = n = 0
        for batch in batches:
            ids, tags, _ = _docs_of(batch)
            for texts in slices(batch.column("text"), 1 << 20):
                gram, doc, first, more, anchor = anchored(texts)
                held.append((texts.data, gram, doc + n, first + size, more, anchor, first - texts.offs[doc]))
                names.append((ids[texts.first : texts.first + len(texts)], tags[texts.first : texts.first + len(texts)]))
                n += len(texts)
                size += len(texts.data)
                if size >= PACK_BYTES:
                    yield flush()
                    held, names, size, n = [], [], 0, 0
        if n:
            yield flush()

    return run


def _table(found: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([rows(found)], SCHEMA)


def _sort(parts: int, doc_parts: int):
    """The repeats of a bucket, by document; what the batches found is passed on."""

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        blobs = [x.as_py() for x in group.column("blob")]
        if part >= parts:
            return _table([(part - parts, _SPANS, b) for b in blobs])
        (start, more, _, anchor, raw), doc, ids, tags = _gathered(blobs, _RUN_KINDS)
        start, more, anchor = (x.astype(np.int64) for x in (start, more, anchor))
        size = more + LENGTH
        r, low, further = repeats_by_anchor(raw, np.cumsum(size) - size, more, anchor, doc, start)
        return _table(_spans(doc[r], start[r] + low, further, ids, tags, doc_parts))

    return run


def _doc_keys(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    return mix(mix(ids.view(np.uint64)) + tags)


def _span_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key of each document with repeats, from packed rows."""
    for batch in batches:
        for blob in batch.column("key"):
            *_, ids, tags = unpack(blob.as_py(), *_SPAN_KINDS)
            yield pa.RecordBatch.from_pydict({"key": pa.array(_doc_keys(np.cumsum(ids), tags).view(np.int64))})


def _touched(batch: pa.RecordBatch, shared) -> np.ndarray:
    """Whether each document may have repeats."""
    ids, tags, _ = _docs_of(batch)
    out = np.zeros(batch.num_rows, bool)
    out[held(shared.value, _doc_keys(ids, tags))] = True
    return out


def _texts(doc_parts: int, shared):
    """Whole documents that may have repeats, by part: ids, tags, lengths and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_touched(batch, shared)))
            ids, tags, none = _docs_of(batch)
            part = _doc_part(ids, tags, doc_parts)
            for texts in slices(batch.column("text"), 8 << 20):
                a = texts.first
                to = part[a : a + len(texts)]
                order = np.argsort(to, kind="stable")
                found = []
                for p, s in by_part(to[order], doc_parts):
                    o = order[s]
                    data = [texts.data[texts.offs[i] : texts.offs[i + 1]] for i in o]
                    found.append((p, _TEXTS, pack(("<i8", ids[a + o]), ("p3", tags[a + o]), ("<u1", none[a + o]), ("<i8", texts.lengths()[o]), ("<u1", np.concatenate(data)))))
                yield rows(found)

    return run


def _whole(shared, with_text: bool):
    """The other documents, which keep every byte, where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~_touched(batch, shared)))
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                out.append((doc, len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), text))
            yield _result(out, with_text).to_batches()[0] if out else pa.RecordBatch.from_pylist([], _result(out, with_text).schema)

    return run


def _read_texts(blob: bytes) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    ids, tags, none, lengths, data = unpack(blob, "<i8", "p3", "<u1", "<i8", "<u1")
    return Texts(data, np.concatenate(([0], np.cumsum(lengths)))), ids, tags, none.astype(bool)


def _lookup(ids: np.ndarray, tags: np.ndarray, own_ids: np.ndarray, own_tags: np.ndarray) -> np.ndarray:
    """Where each (id, tag) stands in own (sorted); -1 if it isn't there."""
    if not len(own_ids):
        return np.full(len(ids), -1)
    known = {k: i for i, k in enumerate(zip(own_ids.tolist(), own_tags.tolist(), strict=True))}
    return np.array([known.get(k, -1) for k in zip(ids.tolist(), tags.tolist(), strict=True)], np.int64)


def united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that touch or overlap as one; starts must ascend."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    return start[new], np.append(reach[:-1][new[1:]], reach[-1])


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_OUT_ARROW = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _OUT.split(", ")])


def _result(found: list[tuple], with_text: bool) -> pa.Table:
    names = [*_OUT_ARROW, pa.field("kept_text", pa.string())] if with_text else list(_OUT_ARROW)
    return pa.table([pa.array([r[k] for r in found], f.type) for k, f in enumerate(names)], schema=pa.schema(names))


def _remove(with_text: bool):
    def run(group: pa.Table) -> pa.Table:
        kinds, blobs = group.column("kind").to_pylist(), [x.as_py() for x in group.column("blob")]
        marked = [b for k, b in zip(kinds, blobs, strict=True) if k == _SPANS]
        own_ids, own_tags = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if marked:
            (start, more, _), doc, own_ids, own_tags = _gathered(marked, _SPAN_KINDS)
            start, end = start.astype(np.int64), start.astype(np.int64) + more.astype(np.int64) + LENGTH
            order = np.lexsort((start, doc))
            doc, start, end = doc[order], start[order], end[order]
        out = []
        for blob in (b for k, b in zip(kinds, blobs, strict=True) if k == _TEXTS):
            texts, ids, tags, none = _read_texts(blob)
            where = _lookup(ids, tags, own_ids, own_tags)
            for i in range(len(texts)):
                data = texts.data[texts.offs[i] : texts.offs[i + 1]]
                n, removed, spans = len(data), 0, 0
                if where[i] >= 0:
                    a, b = np.searchsorted(doc, [where[i], where[i] + 1])
                    s, e = united(start[a:b], end[a:b])
                    spans, removed = len(s), int((e - s).sum())
                    edges = [0, *np.stack([s, e], 1).ravel().tolist(), n]
                    data = np.concatenate([data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
                raw = data.tobytes()
                text = raw.decode("utf-8", "replace") if with_text else None
                out.append((None if none[i] else int(ids[i]), n, removed, spans, hashlib.sha256(raw).hexdigest(), text))
        return _result(out, with_text)

    return run


def repeats_removed(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text), and kept_text if asked for.

    Earlier means a smaller doc_id, or an earlier start in the same document. A null text is empty; a null
    doc_id comes after all others; rows with one doc_id come in the order of a hash of their texts, and rows with one
    doc_id and one text are one document and get the same result; texts under 100 bytes keep every byte; no rows
    give no rows; other columns are ignored. Texts of any length are read whole.
    kept_text replaces bytes of characters that were cut.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(text), F.lit(1 << 24)).alias("tag"))
    size = rows_in.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    plan, doc_parts = planned(rows_in, size), max(24, -(-size // TEXT_BYTES))
    runs = rows_in.mapInArrow(_runs(plan, doc_parts), ROWS)
    spans = keep(runs.groupBy("part").applyInArrow(_sort(plan.parts, doc_parts), ROWS), "repeats")
    # documents without repeats, mostly by far, are finished where they are read; a filter of bounded size tells most of them
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(spans, "blob", made=_span_keys))
    schema = _OUT + (", kept_text string" if with_text else "")
    packed = rows_in.mapInArrow(_texts(doc_parts, shared), ROWS)
    cut = packed.union(spans).groupBy("part").applyInArrow(_remove(with_text), schema)
    return cut.union(rows_in.mapInArrow(_whole(shared, with_text), schema))
