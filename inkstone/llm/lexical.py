"""Ranked lexical search by per-term geometric blocking.

Documents are indexed in shards of a thousand, each a row of a written table. In a shard every long posting list is
cut into blocks of documents that resemble each other (nearest of some of the list's own documents, by signed sums of their
terms), and each block keeps the coordinatewise maximum over its documents: for every term, the most that it can add in any
of them. The maxima are rounded up to steps of STEP, so what a query can score in a block is bounded, exactly.

A query takes its terms by what they can add, most first. A block is skipped only if its bound is below the score
that the query's last result already has, the remaining lists only if all that they can add is; every other document is
scored in full, once. The least score to beat starts from a few shards, searched first. So results are those of a search
through everything, whatever is skipped.

The query set is taken in blocks of bounded size, each against all shards.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batch import LOWER, slices
from .batch import hash_of as hashes_of
from .filters import held, key_filter
from .packing import pack, unpack
from .scratch import drop, keep

TOP = 50
#: Text bytes handled at a time.
SLICE = 1 << 19
#: Unit of the maxima that blocks keep; what a term adds is below 1000000, so they fit into bytes.
STEP = 4096
#: Dimensions of the sums that tell how much documents resemble each other.
SKETCH = 32
#: Terms of all queries that are searched together, about; shards searched first.
QUERY_TERMS, SEEDS = 1 << 18, 8
#: Cells of the table in which maxima are taken.
_CELLS = 1 << 23
#: Documents whose terms are taken into it at a time.
_AT_ONCE = 1024


@dataclass(frozen=True)
class Sizes:
    """Documents of a shard and of a block; posting lists up to short are scored without blocks."""

    shard: int = 1024
    block: int = 128
    short: int = 32


#: Bytes of terms: digits, letters, and all beyond ASCII.
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of all runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def counted(texts, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the number of its terms; hashes and counts of its distinct terms, as far as a filter may hold them, and the place of each text's first."""
    starts, ends, at = texts.runs(TERM[texts.data])
    every = hashes_of(texts.prefix(LOWER[texts.data]), starts, ends)
    some = np.arange(len(every)) if asked is None else held(asked, every)
    every, of = every[some], np.searchsorted(at, some, "right") - 1
    order = np.lexsort((every, of))
    every, of = every[order], of[order]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    return np.diff(at), every[first], np.diff(np.append(first, len(every))), np.searchsorted(of[first], np.arange(len(texts) + 1))


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text"), SLICE):
            _, terms, _, at = counted(texts)
            of = pa.array(np.repeat(np.arange(len(texts)), np.diff(at)) + texts.first)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(of), batch.column("item_id").take(of), pa.array(terms.view(np.int64))], ["item", "item_id", "term"])


def _documents(asked):
    """doc_id, length, terms and counts of every text with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text"), SLICE):
                length, terms, counts, at = counted(texts, asked.value)
                some = np.flatnonzero(length)
                blobs = [pa.array([x[at[i] : at[i + 1]].tobytes() for i in some.tolist()], pa.binary()) for x in (terms, counts.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some + texts.first)), pa.array(length[some].astype(np.int64)), *blobs], ["doc_id", "length", "terms", "counts"])

    return run


def _joined(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind)


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each term how many of these documents hold it."""
    for batch in batches:
        terms, n = np.unique(_joined(batch.column("terms"), np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n)], ["term", "n"])


#: Fields of a shard's index, as they are packed.
_KINDS = {"vocabulary": "<u8", "starts": "p4", "terms": "p4", "adds": "p3", "lists": "p4", "members": "p2", "first_block": "p4", "blocks": "p4", "summaries": "p5", "summary_terms": "p4", "summary_most": "u1"}
_WRAP = 1 << 32


def _blocked(members: np.ndarray, sketches: np.ndarray, block: int) -> tuple[np.ndarray, list[int]]:
    """A posting list in the order of its blocks, and their sizes."""
    k = -(-len(members) // block)
    if k == 1:
        return members, [len(members)]
    own = sketches[members]
    nearest = np.argmax(own @ own[np.arange(k) * len(members) // k].T, axis=1)
    sizes = []
    for n in np.bincount(nearest).tolist():
        sizes += [block] * (n // block) + [n % block] * (n % block > 0)
    return members[np.argsort(nearest, kind="stable")], sizes


def _sketched(terms: np.ndarray, adds: np.ndarray, starts: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """A unit vector for each document: rare terms weigh more, signs come from the terms' hashes."""
    n = len(starts) - 1
    rarity = np.log(1 + n / np.bincount(terms, minlength=len(vocabulary)).clip(1)).astype(np.float32)
    bits = vocabulary[:, None] >> np.arange(SKETCH, dtype=np.uint64)[None] & np.uint64(1)
    signed = (bits.astype(np.float32) * 2 - 1) * rarity[:, None]
    sums = np.zeros((n, SKETCH), np.float32)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        sums[some] = np.add.reduceat(signed[terms] * (adds.astype(np.float32) / 1e6)[:, None], starts[some])
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def index_of(lengths: np.ndarray, hashes: np.ndarray, counts: np.ndarray, starts: np.ndarray, documents: int, all_lengths: int, most_of: Sizes = Sizes()) -> dict[str, np.ndarray]:
    """The index of a shard: what each term adds in each document, posting lists by block, and the blocks' maxima.

    starts: the place of each document's first term in hashes and counts; documents, all_lengths: N and L of the whole collection.
    """
    vocabulary, terms = np.unique(hashes, return_inverse=True)
    fill = 100 - 50 + 50 * lengths * documents // all_lengths
    of = np.repeat(np.arange(len(lengths)), np.diff(starts))
    adds = 1000000000 * counts.astype(np.int64) // (1000 * counts.astype(np.int64) + 20 * fill[of])
    order = np.lexsort((of, terms))
    lists = np.searchsorted(terms[order], np.arange(len(vocabulary) + 1))
    members = of[order]
    sketches = _sketched(terms, adds, starts, vocabulary)
    sizes: list[int] = []
    first_block = np.zeros(len(vocabulary) + 1, np.int64)
    for t in range(len(vocabulary)):
        a, b = lists[t], lists[t + 1]
        if b - a > most_of.short:
            members[a:b], own = _blocked(members[a:b], sketches, most_of.block)
            sizes += own
        first_block[t + 1] = len(sizes)
    # blocks follow each other inside a list; places in members
    long = np.flatnonzero(np.diff(lists) > most_of.short)
    inside = ragged(lists[long], np.diff(lists)[long])
    ends = np.cumsum(np.array(sizes, np.int64))
    begins = ends - np.array(sizes, np.int64)
    most = (-(-adds // STEP)).astype(np.uint8)
    per = np.diff(starts)
    found, values, summaries = [], [], [0]
    width = max(1, len(vocabulary))
    for low in range(0, len(sizes), max(1, _CELLS // width)):
        high = min(len(sizes), low + max(1, _CELLS // width))
        docs = members[inside[begins[low] : ends[high - 1]]]
        block = np.repeat(np.arange(high - low), sizes[low:high])
        table = np.zeros((high - low) * width, np.uint8)
        for a in range(0, len(docs), _AT_ONCE):
            at = ragged(starts[docs[a : a + _AT_ONCE]], per[docs[a : a + _AT_ONCE]])
            np.maximum.at(table, np.repeat(block[a : a + _AT_ONCE], per[docs[a : a + _AT_ONCE]]) * width + terms[at], most[at])
        filled = np.flatnonzero(table)
        found.append(filled % width)
        values.append(table[filled])
        summaries += (np.searchsorted(filled, np.arange(1, high - low + 1) * width) + summaries[-1]).tolist()
    empty = [np.zeros(0, np.int64)]
    out = {"vocabulary": vocabulary, "starts": starts, "terms": terms, "adds": adds, "lists": lists, "members": members, "first_block": first_block, "blocks": np.append(0, ends), "summaries": np.array(summaries)}
    return out | {"summary_terms": np.concatenate(found or empty), "summary_most": np.concatenate(values or empty)}


def packed(index: dict[str, np.ndarray]) -> bytes:
    """An index to be stored; terms of maxima as steps from one to the next."""
    steps = np.diff(index["summary_terms"], prepend=0) % _WRAP
    return pack(*((kind, steps if k == "summary_terms" else index[k]) for k, kind in _KINDS.items()))


def opened(stored: bytes) -> dict[str, np.ndarray]:
    """An index as it was, with the most that each list's term can add."""
    index = dict(zip(_KINDS, unpack(stored, *_KINDS.values()), strict=True))
    index |= {k: index[k].astype(np.int64) for k in _KINDS if k not in ("vocabulary", "summary_most")}
    index["summary_terms"] = np.cumsum(index["summary_terms"]) % _WRAP
    list_most = np.zeros(len(index["vocabulary"]), np.int64)
    np.maximum.at(list_most, index["terms"], -(-index["adds"] // STEP))
    return index | {"list_most": list_most}


def _indexed(documents: int, all_lengths: int, sizes_of: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back: list[pa.RecordBatch] = []

        def shard() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held_back).combine_chunks()
            held_back.clear()
            ids, lengths = rows.column("doc_id").combine_chunks(), np.asarray(rows.column("length"))
            sizes = [len(x.as_buffer()) // 8 for x in rows.column("terms")]
            index = index_of(lengths, _joined(rows.column("terms"), np.uint64), _joined(rows.column("counts"), np.int32), np.append(0, np.cumsum(sizes)), documents, all_lengths, sizes_of)
            return pa.RecordBatch.from_pydict({"doc_ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "index": pa.array([packed(index)], pa.binary())})

        for batch in batches:
            for a in range(0, len(batch), sizes_of.shard):
                piece = batch.slice(a, sizes_of.shard)
                if sum(map(len, held_back)) + len(piece) > sizes_of.shard:
                    yield shard()
                held_back.append(piece)
        if held_back and sum(map(len, held_back)):
            yield shard()

    return run


class Best:
    """The best results of each query so far (top at most), and the least score that a further one needs."""

    def __init__(self, least: np.ndarray, top: int = TOP):
        self.top, self.least = top, least.copy()
        self.scores = [np.zeros(0, np.int64)] * len(least)
        self.ids = [np.zeros(0, np.int64)] * len(least)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        near = scores >= self.least[query]
        if not near.any():
            return
        scores, ids = np.concatenate([self.scores[query], scores[near]]), np.concatenate([self.ids[query], ids[near]])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores[query], self.ids[query] = scores[order], ids[order]
        if len(order) == self.top:
            self.least[query] = max(self.least[query], scores[order[-1]])


def search(index: dict[str, np.ndarray], ids: np.ndarray, query: int, hashes: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Add a shard's results of one query to best. Returns how many documents were scored."""
    vocabulary, terms, adds, starts = index["vocabulary"], index["terms"], index["adds"], index["starts"]
    place = np.searchsorted(vocabulary, hashes)
    here = (place < len(vocabulary)) & (vocabulary[np.minimum(place, len(vocabulary) - 1)] == hashes) & (weights > 0)
    place, weights = place[here], weights[here]
    if not len(place):
        return 0
    most = weights * index["list_most"][place] * STEP
    order = np.argsort(-most, kind="stable")
    place, most, weights = place[order], most[order], weights[order]
    rest = np.cumsum(most[::-1])[::-1]  # what this list and those after it can add
    if rest[0] < best.least[query]:
        return 0
    weight = np.zeros(len(vocabulary), np.int64)
    weight[place] = weights
    seen = np.zeros(len(starts) - 1, bool)
    scored = 0

    def score(docs: np.ndarray) -> int:
        docs = docs[~seen[docs]]
        if len(docs):
            seen[docs] = True
            per = starts[docs + 1] - starts[docs]
            at = ragged(starts[docs], per)
            best.add(query, np.add.reduceat(weight[terms[at]] * adds[at], np.cumsum(per) - per), ids[docs])
        return len(docs)

    for k, t in enumerate(place.tolist()):
        if rest[k] < best.least[query]:
            break
        members = index["members"][index["lists"][t] : index["lists"][t + 1]]
        low, high = index["first_block"][t], index["first_block"][t + 1]
        if low == high:
            scored += score(members)
            continue
        a, b = index["summaries"][low], index["summaries"][high]
        bound = STEP * np.add.reduceat(weight[index["summary_terms"][a:b]] * index["summary_most"][a:b], index["summaries"][low:high] - a)
        begin = index["blocks"][low : high + 1] - index["blocks"][low]
        by = np.argsort(-bound, kind="stable")
        step = 1
        while len(by):
            by = by[bound[by] >= best.least[query]]
            now, by = by[:step], by[step:]
            scored += score(members[ragged(begin[now], begin[now + 1] - begin[now])])
            step *= 2
    return scored


def _searched(queries, top: int):
    """item, doc_id, score of the best results that these shards have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, at, hashes, weights, least = queries.value
        best, null = Best(least, top), np.iinfo(np.int64).max
        for batch in batches:
            for i in range(len(batch)):
                ids = np.asarray(batch.column("doc_ids")[i].values.fill_null(null))
                index = opened(batch.column("index")[i].as_buffer())
                if len(index["vocabulary"]):
                    for q in range(len(items)):
                        search(index, ids, q, hashes[at[q] : at[q + 1]], weights[at[q] : at[q + 1]], best)
        of = np.repeat(np.arange(len(items)), [len(x) for x in best.ids])
        if len(of):
            ids = np.concatenate(best.ids)
            yield pa.RecordBatch.from_arrays([pa.array(items[of]), pa.array(ids, mask=ids == null), pa.array(np.concatenate(best.scores))], ["item", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, sizes: Sizes = Sizes()) -> DataFrame:
    """item_id, rank, doc_id and score of the top best documents (doc_id, text) for each row of items (item_id, text), scores above 0.

    Null and empty texts have no terms: such a document is never found, such an item finds none. Texts of any length are read
    whole. Equal scores rank by doc_id, a null one last; rows with one doc_id are found each for itself. Each row of items has
    ranks of its own, whatever its item_id. No documents or no items give no rows; other columns are ignored. Terms are compared
    by 64-bit hashes.
    """
    spark = docs.sparkSession
    numbered = keep(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text"), "lexical-items")
    asked = keep(numbered.mapInArrow(_queries, "item long, item_id long, term long"), "lexical-asked")
    vocabulary = spark.sparkContext.broadcast(key_filter(asked.select("term").distinct(), "term"))
    forward = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_documents(vocabulary), "doc_id long, length long, terms binary, counts binary"), "lexical-documents")
    documents, all_lengths = forward.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    holders = forward.select("terms").mapInArrow(_holders, "term long, n long").groupBy("term").agg(F.sum("n").alias("holders"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("holders") + 1)))
    weighed = asked.join(holders, "term").select("item", "item_id", "term", weight.alias("weight"))
    parts = max(1, -(-2 * asked.count() // QUERY_TERMS))
    weighed = keep(weighed.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts))), "lexical-queries")
    index = keep(forward.mapInArrow(_indexed(documents, all_lengths, sizes), "doc_ids array<long>, index binary"), "lexical-index")
    drop(forward)
    shards = index.count()
    seeds = index.sample(fraction=min(1.0, SEEDS / shards), seed=7) if shards > 2 * SEEDS else None
    results = []
    for part in range(parts):
        block = weighed.filter(F.col("part") == part).select("item", "term", "weight").orderBy("item").toArrow()
        terms, weights = (np.asarray(block.column(c)) for c in ("term", "weight"))
        of, at = np.unique(np.asarray(block.column("item")), return_index=True)
        at, least = np.append(at, len(terms)), np.ones(len(of), np.int64)
        search_for = lambda least: _searched(spark.sparkContext.broadcast((of, at, terms.view(np.uint64), weights, least)), top)  # noqa: B023, E731
        if seeds is not None:
            first = _ranked(seeds.mapInArrow(search_for(least), "item long, doc_id long, score long"), top)
            for item, score in first.filter(F.col("rank") == top).select("item", "score").collect():  # a number for each query of the block
                least[np.searchsorted(of, item)] = score
        results.append(keep(_ranked(index.mapInArrow(search_for(least), "item long, doc_id long, score long"), top), "lexical-results"))
    drop(index)
    found = functools.reduce(DataFrame.union, results)
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
