"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of a few neighbouring words and ignore the others, so a seed matches across
substituted words. Seeds of the benchmark items and of the documents are joined on their hash; around each hit
the item is laid over the document, and the best window of WINDOW words (the whole item if it is
shorter) is counted. From 80 % equal words on the document holds the item, so an item of fewer than five words must
occur exactly.

The masks are complete: any window of 5 to 20 words with at most a fifth of its words substituted holds
one of them in unsubstituted words (tests/llm checks all patterns), so no such overlap is lost. Most windows hold more
(least_hits), so of the seeds in a window all but that many less one can be left out: those that many
items share go first, and an opening that all items have in common meets no document.

A filter of the items' seeds, of bounded size, keeps most seeds of the documents out of the join; what it lets
through by mistake the join drops. Seeds that many documents hold are salted, and items are compared with
all documents of a seed at once, in arrays.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import LOWER, SPACE, Texts, frugal, hash_of, mix, release, slices
from .filters import held, key_filter
from .scratch import counted, keep, narrow, rows

#: Word offsets that each mask looks at.
MASKS = ((0, 1, 2, 4), (0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4))
#: The same for items of one to three words (those of four have the second of MASKS).
SHORT_MASKS = ((0,), (0, 1), (0, 1, 2))
WINDOW, SIMILAR, LEAST_WORDS = 20, 0.8, 5
#: Items that share a seed from which on it is left out where that loses nothing.
HOT_ITEMS = 8
#: Hits in a bucket of the join, about, and pairs that are compared at a time.
BUCKET, BLOCK = 100_000, 40_000
#: Parts of the items whose seeds are looked at together.
PARTS = 4096
#: Words on each side of a hit that travel with it: any window around it lies within.
_SIDE = WINDOW - 1
_SPAN = 2 * _SIDE + 1

_LETTER = ~SPACE
_LETTER[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80), *range(0, 9), *range(14, 32)]] = False


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (never 0) of the words (runs of letters, digits and bytes beyond ASCII, lower-cased), and word offsets."""
    data = LOWER[texts.data]
    starts, ends, offs = texts.runs(_LETTER[data])
    return np.maximum(hash_of(texts.prefix(data), starts, ends), np.uint64(1)), offs


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the mask laid at each word (fewer by the mask's span)."""
    n = max(0, len(words) - mask[-1])
    out = np.full(n, sum((o + 1) << (3 * k) for k, o in enumerate(mask)), np.uint64)
    for o in mask:
        out = out * np.uint64(0x9FB21C651E98DF25) + words[o : o + n]
    return mix(out)


def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks that find an item of n words."""
    return SHORT_MASKS[n - 1 : n] if n < 4 else MASKS[1:2] if n == 4 else MASKS


@functools.cache
def least_hits(n: int) -> int:
    """How many masks any admissible pattern of substitutions in a window of n words leaves whole, at least."""
    if n < LEAST_WORDS:
        return 1
    placed = np.array([[x - i in m for x in range(n)] for m in MASKS for i in range(n - m[-1])])
    return min(int((~placed[:, list(gone)].any(1)).sum()) for gone in combinations(range(n), n - int(np.ceil(SIMILAR * n - 1e-9))))


# Items.

_SEED = "seed long, item long, place int, span int, words int"


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SEED.split(", ")]
    for batch in batches:
        items = np.asarray(batch.column("item"))
        for texts in slices(batch.column("text")):
            words, offs = tokens(texts)
            found: list[list[np.ndarray]] = []
            for i in range(len(texts)):
                w = words[offs[i] : offs[i + 1]]
                for m in masks_for(len(w)) if len(w) else ():
                    s = seeds(w, m).view(np.int64)
                    found.append([s, np.full(len(s), items[texts.first + i]), np.arange(len(s), dtype=np.int32), np.full(len(s), m[-1] + 1, np.int32), np.full(len(s), len(w), np.int32)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text")):
            words, offs = tokens(texts)
            ids, items = (batch.column(c).slice(texts.first, len(texts)) for c in ("item_id", "item"))
            yield pa.RecordBatch.from_arrays([items, ids, pa.array([words[a:b].tobytes() for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False)], pa.binary())], ["of", "item_id", "whole"])


def spared(place: np.ndarray, span: np.ndarray, words: int) -> np.ndarray:
    """Which seeds of an item, given from the most to the least common, can be left out without losing an overlap."""
    n = min(WINDOW, words)
    gone, out = np.zeros(words - n + 1, np.int64), np.zeros(len(place), bool)
    for i, (p, s) in enumerate(zip(place.tolist(), span.tolist(), strict=True)):
        windows = slice(max(0, p + s - n), min(p, words - n) + 1)
        if gone[windows].max() < least_hits(n) - 1:
            gone[windows] += 1
            out[i] = True
    return out


def _spare(group: pa.Table) -> pa.Table:
    """The seeds of a part's items, without the common ones that can be left out."""
    rare = pc.less_equal(group.column("n"), HOT_ITEMS)
    names = [x.split()[0] for x in _SEED.split(", ")]
    kept = group.filter(rare).select(names)
    group = group.filter(pc.invert(rare))
    if not len(group):
        return kept
    group = group.sort_by([("item", "ascending"), ("n", "descending"), ("place", "ascending"), ("seed", "ascending")])
    item, place, span, words = (np.asarray(group.column(c)) for c in ("item", "place", "span", "words"))
    cuts = np.flatnonzero(np.diff(item)) + 1
    out = [spared(place[a:b], span[a:b], int(words[a])) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(item)], strict=True)]
    return pa.concat_tables([kept, group.select(names).filter(pa.array(~np.concatenate(out)))])


def item_seeds(items: DataFrame) -> DataFrame:
    """The seeds (seed, item, place, span, words) of items (item, text) that documents are searched for."""
    every = items.mapInArrow(_item_seeds, _SEED)
    known = every.join(every.groupBy("seed").agg(F.count("*").alias("n")), "seed")  # a seed of many items is split like any skewed key
    part = F.pmod(F.xxhash64("item"), F.lit(PARTS)).alias("part")
    return keep(known.select(part, "*").groupBy("part").applyInArrow(_spare, _SEED), "seeds")


# Documents.

_HIT = "seed long, doc_id long, tag long, at int, around binary"


def _around(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The words around each place (a row each), 0 beyond low and high."""
    where = at[:, None] + np.arange(-_SIDE, _SIDE + 1)
    inside = (where >= low[:, None]) & (where < high[:, None])
    return np.where(inside, words[np.clip(where, 0, len(words) - 1)], np.uint64(0))


def _blobs(rows: np.ndarray) -> pa.Array:
    offs = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _hits(shared, masks: tuple[tuple[int, ...], ...]):
    """Hits of the filter with the words around them, and for each row that has any a row without a seed."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _HIT.split(", ")]
        for batch in batches:
            ids, tags = batch.column("doc_id").cast(pa.int64()), batch.column("tag")
            for texts in slices(batch.column("text")):
                words, offs = tokens(texts)
                found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
                for mask in masks:
                    s = seeds(words, mask)
                    at = held(shared.value, s)
                    at = at[at + mask[-1] < offs[np.searchsorted(offs, at, "right")]]
                    found.append((s[at], at))
                seed, at = (np.concatenate(x) for x in zip(*found, strict=True))
                doc = np.searchsorted(offs, at, "right") - 1
                some = np.unique(doc)
                if not len(some):
                    continue
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), ids.take(pa.array(texts.first + some)), tags.take(pa.array(texts.first + some)), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary())], names)
                for b in range(0, len(at), BLOCK):
                    s, a, d = seed[b : b + BLOCK], at[b : b + BLOCK], doc[b : b + BLOCK]
                    of = pa.array(texts.first + d)
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), ids.take(of), tags.take(of), pa.array((a - offs[d]).astype(np.int32)), _blobs(_around(words, a, offs[d], offs[d + 1]))], names)

    return run


_PAIR = "doc_id long, tag long, item long, item_id long, first_word long, equal_words long, window_words long"


def best_windows(doc: np.ndarray, item: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word (in the rows) and equal words of the best window of n words of each pair of rows of words."""
    score = np.where((doc == 0) | (item == 0), -WINDOW, doc == item).astype(np.int16)
    sums = np.concatenate([np.zeros((len(score), 1), np.int16), np.cumsum(score, 1, dtype=np.int16)], 1)
    first, equal = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for w in np.unique(n).tolist():
        these = np.flatnonzero(n == w)
        counts = sums[these, w:] - sums[these, :-w]
        first[these] = counts.argmax(1)
        equal[these] = counts.max(1)
    return first, equal


def _verify(hits: pa.Table, entries: pa.Table) -> pa.Table:
    """The windows of a bucket's hits that are similar to an item with the hit's seed."""
    kinds = pa.schema([(x.split()[0], pa.int64()) for x in _PAIR.split(", ")])
    if not len(hits) or not len(entries):
        return kinds.empty_table()
    hits, entries = hits.sort_by("seed").combine_chunks(), entries.sort_by("seed").combine_chunks()
    seed, at = np.asarray(hits.column("seed")), np.asarray(hits.column("at")).astype(np.int64)
    around = np.frombuffer(b"".join(x.as_py() for x in hits.column("around")), np.uint64).reshape(-1, _SPAN)
    own, place, size = (np.asarray(entries.column(c)) for c in ("seed", "place", "words"))
    low = np.concatenate(([0], np.cumsum(size)))
    whole = np.frombuffer(b"".join(x.as_py() for x in entries.column("whole")), np.uint64)
    first, last = np.searchsorted(own, seed, "left"), np.searchsorted(own, seed, "right")
    ends = np.cumsum(last - first)
    out = []
    for b in range(0, int(ends[-1]), BLOCK):
        pair = np.arange(b, min(b + BLOCK, int(ends[-1])))
        h = np.searchsorted(ends, pair, "right")
        e = last[h] - (ends[h] - pair)
        these = _around(whole, low[e] + place[e], low[e], low[e + 1])
        n = np.minimum(WINDOW, size[e]).astype(np.int64)
        start, equal = best_windows(around[h], these, n)
        ok = equal >= SIMILAR * n - 1e-9
        h, e, n = h[ok], e[ok], n[ok]
        part = pa.table({"doc_id": hits.column("doc_id").take(pa.array(h)), "tag": hits.column("tag").take(pa.array(h)), "item": entries.column("item").take(pa.array(e)), "item_id": entries.column("item_id").take(pa.array(e)), "first_word": at[h] - _SIDE + start[ok], "equal_words": equal[ok], "window_words": n})
        out.append(part.cast(kinds).group_by(["doc_id", "tag", "item", "item_id", "window_words", "equal_words"]).aggregate([("first_word", "min")]).rename_columns(["doc_id", "tag", "item", "item_id", "window_words", "equal_words", "first_word"]).select(kinds.names))
    del hits, entries, around, whole
    release()
    return pa.concat_tables(out).cast(kinds) if out else kinds.empty_table()


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")


def _found(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, tag (of the text), item_id and best window of each item in each text; and how many rows each doc_id and tag with hits has."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    wanted = item_seeds(items)
    many, short = wanted.agg(F.count("*"), F.collect_set(F.when(F.col("words") < 4, F.col("words")))).first()  # three numbers at most
    masks = MASKS + tuple(SHORT_MASKS[n - 1] for n in sorted(short))
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(wanted, "seed", many))
    with narrow(docs.sparkSession):
        hits = keep(counted(_tagged(docs).mapInArrow(_hits(shared, masks), _HIT)), "seeds-hits")
    shared.destroy()
    real = hits.filter("seed is not null")
    counts = real.groupBy("seed").agg(F.count("*").alias("hits"))
    buckets = max(8, -(-rows(hits) // BUCKET))
    # of the seeds with hits at most one in a bucket has more than one salt
    salts = counts.filter(F.col("hits") > BUCKET).select("seed", F.ceil(F.col("hits") / BUCKET).cast("int").alias("salts"))
    bucket = F.pmod(F.xxhash64("seed", "salt"), F.lit(buckets)).alias("bucket")
    met = wanted.join(counts, "seed").withColumn("salts", F.ceil(F.col("hits") / BUCKET).cast("int"))
    entries = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    words = items.mapInArrow(_item_words, "of long, item_id long, whole binary")
    entries = entries.join(words, F.col("item") == F.col("of")).select(bucket, "seed", "item", "item_id", "place", "words", "whole")
    salted = real.join(salts, "seed", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "tag", "at"), F.col("salts")), F.lit(0)).cast("int"))
    pairs = salted.select(bucket, "seed", "doc_id", "tag", "at", "around").groupBy("bucket").cogroup(entries.groupBy("bucket")).applyInArrow(_verify, _PAIR)
    best = F.max(F.struct("equal_words", (-F.col("first_word")).alias("before"))).alias("best")
    found = pairs.groupBy("doc_id", "tag", "item", "item_id", "window_words").agg(best)
    found = found.select("doc_id", "tag", "item_id", (-F.col("best.before")).alias("first_word"), F.col("best.equal_words").alias("equal_words"), "window_words")
    holders = hits.filter("seed is null").groupBy(F.col("doc_id").alias("row_id"), F.col("tag").alias("row_tag")).agg(F.count("*").alias("n"))
    return found, holders


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, equal_words, window_words, similarity: a row for each item that a row of docs holds.

    docs (doc_id, text), benchmark (item_id, text). Where an item occurs more than once, its best (then
    first) window is given. A null or empty text holds nothing; items of fewer than LEAST_WORDS words must occur
    exactly; items without words or with a null text match nothing; repeated rows of docs are reported each, repeated
    items once; a null doc_id or item_id is reported as such; no rows give no rows; other columns are ignored. Texts of any length are searched whole.
    """
    found, holders = _found(docs, benchmark)
    each = found.join(holders, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("tag") == F.col("row_tag"))).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each.select("doc_id", "item_id", "first_word", "equal_words", "window_words", (F.col("equal_words") / F.col("window_words")).alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item of least_words words or more.

    Shorter items are names and phrases that clean documents hold as well; overlaps() reports them. A null or empty
    text is clean; repeated rows, and rows with one doc_id and text, stay or go together; a null doc_id is an id like
    others; texts of any length are searched whole; no rows give no rows; columns of docs may have any names.
    """
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    found = _found(docs, benchmark)[0].filter(F.col("window_words") >= least_words)
    bad = keep(found.select(F.col("doc_id").alias(mark + "id"), F.col("tag").alias(mark + "tag")).distinct(), "seeds-found")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(mark + "id")) & (F.xxhash64("text") == F.col(mark + "tag"))
    return docs.join(bad, same, "left_anti")
