"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints with at most 4 differing bits, cut into 3 segments, have a segment with at most one
differing bit: its variants with that one bit left out are equal. So each fingerprint is indexed under
64 one-wildcard variants (one per bit), variants are joined on equality, and candidates are verified on
all 64 bits. Inside a variant, the bits outside the segment hold at most 4 differences, so one of 5 parts
of them is equal: candidates are compared within equal parts only, not all with all.

Only distinct fingerprints are indexed; copies follow their fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefixes
from .batch import LOWER, frugal, release, slices
from .components import components
from .scratch import counted, drop, keep, narrow, rows, sweep

SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENTS = ((0, 21), (21, 42), (42, 64))
PARTS = 5
#: Variants that one bucket of the index holds, about.
BUCKET = 1 << 20

_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view(np.uint64).ravel()


def shingle_hashes(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """XXH64 of the n-word shingles of lower-cased text; of the whole sequence if it has fewer words, none without words."""
    words = text.split()  # at ASCII white space
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - n + 1)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the bits that are set in over half of them (0 for none)."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    every, n = np.concatenate([hashes[i] for i in some]), sizes[some]
    # counters are bytes side by side in 64 bits, so they are summed over 255 hashes at most
    blocks = -(-n // 255)
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    starts = np.repeat(begin, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    for k, column in enumerate(every.view(np.uint8).reshape(-1, 8).T):
        sums = np.add.reduceat(_LANES[column], starts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(sums.astype(np.int64), first, axis=0)
        bits = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").ravel()
        out[some] |= bits.astype(np.uint64) << np.uint64(8 * k)
    return out


@frugal
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, tag and the 64 fingerprint bits (as a signed long) of every row; null text: 0."""
    for batch in batches:
        out = []
        for texts in slices(batch.column("text")):
            data, offs = LOWER[texts.data].tobytes(), texts.offs.tolist()
            out.append(majority([shingle_hashes(data[a:b]) for a, b in zip(offs, offs[1:], strict=False)]))
        if out:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(np.concatenate(out).view(np.int64))], ["doc_id", "tag", "bits"])


def variants(bits: np.ndarray) -> np.ndarray:
    """Keys of the 64 one-wildcard variants of each fingerprint (a row each): the wildcard's bit and the rest of its segment."""
    out = np.empty((len(bits), 64), np.uint32)
    for lo, hi in SEGMENTS:
        value = (bits >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        for k in range(lo, hi):
            out[:, k] = (value & ~np.uint64(1 << (k - lo))) | np.uint64(k << 22)
    return out


def _index(buckets: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.asarray(batch.column("bits")).view(np.uint64)
            if not len(bits):
                continue
            keys = variants(bits).ravel()
            bits = np.repeat(bits, 64)
            to = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            keys, bits, to = keys[order], bits[order], to[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(to)]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(to[starts].astype(np.int32)), "keys": [keys[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], "bits": [bits[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]})

    return run


class Roots:
    """Connected nodes 0 to n-1: the least node in reach of each."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            rx, ry = self.of[x], self.of[y]
            apart = rx != ry
            if not apart.any():
                return
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            np.minimum.at(self.of, np.maximum(rx, ry), np.minimum(rx, ry))
            while (self.of[self.of] != self.of).any():
                self.of = self.of[self.of]


def matches(keys: np.ndarray, bits: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, root) that connect what shares a variant key and differs in at most distance bits, one for each that is no root.

    A run of candidates is left as soon as all of it is connected, so a large cluster of near fingerprints takes few comparisons of each.
    """
    nodes, node = np.unique(bits, return_inverse=True)
    roots = Roots(len(nodes))
    for lo, hi in SEGMENTS:
        here = np.flatnonzero(((keys >> 22) >= lo) & ((keys >> 22) < hi))
        if not len(here):
            continue
        k, b = keys[here], bits[here]
        rest = [i for i in range(64) if not lo <= i < hi]
        for part in np.array_split(np.array(rest), PARTS):
            mask = np.uint64(sum(1 << int(i) for i in part))
            order = np.lexsort((b & mask, k))
            ks, bs, own = k[order], b[order], node[here][order]
            new = np.ones(len(ks), bool)
            new[1:] = (ks[1:] != ks[:-1]) | (bs[1:] & mask != bs[:-1] & mask)
            first, run = np.flatnonzero(new), np.cumsum(new) - 1
            last = np.append(first[1:], len(bs))[run] - 1
            at = np.flatnonzero(np.arange(len(bs)) < last)
            step, look, linked = 1, 1, []
            while len(at):
                if step == look:
                    if linked:
                        roots.link(*map(np.concatenate, zip(*linked, strict=True)))
                    root, linked, look = roots.of[own], [], 2 * look
                    several = np.minimum.reduceat(root, first) < np.maximum.reduceat(root, first)
                    at = at[several[run[at]]]
                near = np.bitwise_count(bs[at] ^ bs[at + step]) <= distance
                linked.append((own[at[near]], own[at[near] + step]))
                step += 1
                at = at[at + step <= last[at]]
            if linked:
                roots.link(*map(np.concatenate, zip(*linked, strict=True)))
    other = np.flatnonzero(roots.of != np.arange(len(nodes)))
    return nodes[other], nodes[roots.of[other]]


def _verify(group: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("keys")])
    bits = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group.column("bits")])
    a, b = matches(keys, bits)
    release()
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def near_links(distinct: DataFrame, n: int) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (bits; n distinct ones) in reach of each other by steps of at most 4 bits."""
    buckets = max(24, -(-64 * n // BUCKET))
    index = distinct.select("bits").mapInArrow(_index(buckets), "bucket int, keys binary, bits binary")
    return index.groupBy("bucket").applyInArrow(_verify, "a long, b long")


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, tag, text of every row of docs: the tag tells rows with one doc_id and different texts apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, tag, bits, root (the group) and component_id of every row of docs (doc_id, text)."""
    with narrow(docs.sparkSession):
        prints = keep(tagged(docs).mapInArrow(_fingerprints, "doc_id long, tag long, bits long"), "simhash-rows")
        distinct = keep(counted(prints.groupBy("bits").agg(F.min("doc_id").alias("least"))), "simhash-distinct")
        many = rows(distinct)
        links = keep(near_links(distinct, many), "simhash-links")
        root = components(links)
        known = keep(distinct.join(root, distinct.bits == root.id, "left").select("bits", "least", F.coalesce("root", "bits").alias("root")), "simhash-roots", many)
        for x in (distinct, links, root):
            drop(x)
        least = known.groupBy("root").agg(F.min("least").alias("component_id"))
        member = keep(known.join(least, "root").select(F.col("bits").alias("of"), "root", "component_id"), "simhash-members", many)
        drop(known)
        sweep(docs.sparkSession)
        return prints.join(member, prints.bits == member.of).select("doc_id", "tag", "bits", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id in reach) of every row of docs (doc_id, text).

    A null text and one without words have fingerprint zero and are linked like others; repeated rows are
    copies of each other; a null doc_id is never the smallest unless there is no other; no rows give no
    rows; other columns are ignored. All shingles of a text of any length vote; a bit with as many votes for as against it is 0.
    """
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def candidates(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different sets (tag, id, n of each row's set of shingles) whose fingerprints are in one group: each with that of the least id."""
    of, many = sets.filter("n > 0").select("tag", "id").distinct(), sets.count()
    known = keep(grouped(docs).select("tag", F.col("root").alias("group")).distinct().join(of, "tag").select("group", "id").distinct(), "simhash-sets", many)
    lead = known.groupBy("group").agg(F.min("id").alias("a"))
    return keep(known.join(lead, "group").filter("id <> a").select("a", F.col("id").alias("b")).distinct(), "simhash-near", many)


def alike(docs: DataFrame) -> DataFrame:
    """doc_id, tag, root (the group) of every row of docs (doc_id, text), as prefixes.grouped() has them: texts linked by a similarity of 0.8 at least.

    Fingerprints are made, indexed by their variants and grouped first, and the similarity of what they bring together is checked on the whole sets. Links
    that fingerprints don't show, being further apart, come from the similarity join, among what isn't connected yet.
    """
    return prefixes.grouped(docs, lambda sets: candidates(docs, sets))


def deduplicated(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = grouped) -> DataFrame:
    """One row of docs, with all its columns, for each group: of the smallest doc_id, and of its rows that with the least hash of its text.

    groups gives doc_id, tag and root (the group) of every row, by 4 bits of the fingerprint unless another is given. Of
    rows with one doc_id and text one stays; rows without a doc_id are members of groups like others and stay only where no
    member has one; null and empty texts are one group; no rows give no rows; columns of docs may have any names.
    Which rows stay is decided on ids and hashes, ties by the least hash; texts, of any length, take part in one join.
    """
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    none, of, tag = (mark + x for x in ("none", "of", "tag"))
    key = [F.col("doc_id").isNull().alias(none), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(of)]
    lead = groups(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("of"), "tag")).alias("lead"))
    lead = keep(lead.select(F.col("lead.none").alias(none), F.col("lead.of").alias(of), F.col("lead.tag").alias(tag)), "dedup-lead")
    kept = docs.withColumns({none: key[0], of: key[1], tag: F.xxhash64("text")}).join(lead, [none, of, tag])
    return kept.dropDuplicates([none, of, tag]).select(*docs.columns)
