"""Similarity join of texts on sets of word shingles: all that are linked by a Jaccard similarity of 0.8 at least.

Grouped prefix join. Shingles have one order, rare ones first; two sets as similar as that share one among the first fifth of
each, its prefix, and only shingles that stand in the prefixes of several sets make lists. Sets with the same prefix and size
are one group: sizes and places are compared between groups, and only pairs of groups that pass are expanded into pairs of
sets, which a bitmap of each set's shingles and then the whole sets must confirm. No hash of a whole prefix or bitmap decides
on a link, and no pair that could be a link is left out.

The order is by counts of all shingles in a table of fixed size; two shingles in one cell only share their rank, which is
the same everywhere, so the order stays one order and the join exact, however full the table is.

Components don't need every link. First the sets of each list are compared with one of them, that which shares most (the
original among its copies), so that a large group of copies takes one comparison a member. Lists whose sets are not
connected by then are gone through in pieces: the nearest pairs of each two components, and at last all pairs that are left.
Lists with the same sets are one list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batch import LOWER, Texts, frugal, hash_of, mix, roll, slices
from .components import components
from .filters import held, key_filter
from .scratch import counted, drop, keep, narrow, rows, sweep

SHINGLE = 5
#: Text bytes handled at a time.
SLICE = 1 << 19
#: The least similarity is LEAST / OF.
LEAST, OF = 80, 100
#: Cells in which shingles are counted, and pieces in which they are summed, as powers of two.
CELLS, PIECES = 22, 6
#: 64-bit words of a set's bitmap.
BITMAP = 16
#: Sets of one list that are compared with each other in a task; pairs of two components in the first pass through a list.
PIECE, FIRST = 2048, 4


def needed(a, b):
    """How many shingles two sets of sizes a and b must share to be linked."""
    return -(-LEAST * (a + b) // (LEAST + OF))


def prefix_size(n):
    """How many of n shingles in their order a linked set can't all lack."""
    return n - -(-LEAST * n // OF) + 1


def shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of the shingles of each text (of all its words if it has fewer), sorted, and the offset of each text; only A-Z are lower-cased."""
    starts, ends, at = texts.words()
    words = hash_of(texts.prefix(LOWER[texts.data]), starts, ends)
    n = np.diff(at)
    hashes, owner = [], []
    if len(words) >= SHINGLE:
        of = np.searchsorted(at, np.arange(len(words) - SHINGLE + 1), "right") - 1
        inside = np.arange(len(of)) + SHINGLE <= at[of + 1]
        hashes.append(roll(words, SHINGLE)[inside])
        owner.append(of[inside])
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)).tolist():
        hashes.append(roll(words[at[i] : at[i + 1]], int(n[i])))
        owner.append(np.array([i]))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    every, of = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((every, of))
    every, of = every[order], of[order]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]) | (of[1:] != of[:-1])
    every, of = every[new], of[new]
    return every, np.searchsorted(of, np.arange(len(texts) + 1))


def cell(hashes: np.ndarray) -> np.ndarray:
    """The cell in which a shingle is counted."""
    return (mix(hashes) >> np.uint64(64 - CELLS)).astype(np.int64)


@frugal
def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << CELLS, np.uint32)
    for batch in batches:
        for texts in slices(batch.column("text"), SLICE):
            at, n = np.unique(cell(shingle_sets(texts)[0]), return_counts=True)
            total[at] += n.astype(np.uint32)
    pieces = np.minimum(total, 65535).astype(np.uint16).reshape(1 << PIECES, -1)
    some = np.flatnonzero(pieces.any(1))
    pack = zstandard.ZstdCompressor(level=1).compress
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pack(pieces[i].tobytes()) for i in some.tolist()], pa.binary())], ["piece", "tally"])


@frugal
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for piece, tally in zip(batch.column("piece").to_pylist(), batch.column("tally"), strict=True):
            now = np.frombuffer(unpack(tally.as_py()), np.uint16).astype(np.uint32)
            total[piece] = np.minimum(total[piece] + now, 65535) if piece in total else now
    pack = zstandard.ZstdCompressor(level=1).compress
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack(x.astype(np.uint16).tobytes()) for x in total.values()], pa.binary())], ["piece", "tally"])


def tallies(texts: DataFrame) -> np.ndarray:
    """How many sets of shingles hold one of each cell, up to 65535: 1 << CELLS numbers."""
    schema = "piece int, tally binary"
    some = texts.select("text").mapInArrow(_tallies, schema).withColumn("salt", F.spark_partition_id() % 64)
    summed = some.repartition("piece", "salt").select("piece", "tally").mapInArrow(_summed, schema).repartition("piece").mapInArrow(_summed, schema)
    out = np.zeros((1 << PIECES, 1 << (CELLS - PIECES)), np.uint16)
    for r in summed.collect():  # the pieces of one table of fixed size
        out[r["piece"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["tally"]), np.uint16)
    return out.ravel()


def bitmaps(every: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each set a row of BITMAP words; a bit tells whether an odd number of its shingles falls on it. Two sets differ in as many shingles as bits at least."""
    bits = 64 * BITMAP
    of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    odd = np.bincount(of * bits + (mix(every + np.uint64(1)) % np.uint64(bits)).astype(np.int64), minlength=(len(offs) - 1) * bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64).reshape(-1, BITMAP)


def prefixes(every: np.ndarray, offs: np.ndarray, tally: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefixes of sets, in order, their ranks, and the offset of each."""
    n = np.diff(offs)
    of = np.repeat(np.arange(len(n)), n)
    rank = tally[cell(every)]
    order = np.lexsort((every, rank, of))
    first = np.arange(len(every)) - offs[of] < prefix_size(n)[of]
    return every[order][first], rank[order][first], np.append(0, np.cumsum(prefix_size(n)))


def _set_ids(every: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(every[a:b].tobytes()) for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False)], np.uint64)


def _described(tally):
    """Each row with its set and its size; the first row of a set in this task has the set's prefix, their ranks and its bitmap, too."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            done = 0
            for texts in slices(batch.column("text"), SLICE):
                every, offs = shingle_sets(texts)
                ids, n = _set_ids(every, offs), np.diff(offs)
                new = [i for i, x in enumerate(ids.tolist()) if n[i] and x not in seen and not seen.add(x)]
                more: list[list] = [[None] * len(ids) for _ in range(3)]
                if new:
                    whole, own = np.concatenate([every[offs[i] : offs[i + 1]] for i in new]), np.append(0, np.cumsum(n[new]))
                    shingles, rank, at = prefixes(whole, own, tally.value)
                    for i, a, b, bits in zip(new, at[:-1].tolist(), at[1:].tolist(), bitmaps(whole, own), strict=True):
                        more[0][i], more[1][i], more[2][i] = shingles[a:b].tobytes(), rank[a:b].tobytes(), bits.tobytes()
                of = [batch.column(c).slice(done, len(ids)) for c in ("doc_id", "tag")]
                done += len(ids)
                yield pa.RecordBatch.from_arrays([*of, pa.array(ids.view(np.int64)), pa.array(n), *(pa.array(x, pa.binary()) for x in more)], ["doc_id", "tag", "id", "n", "prefix", "ranks", "bits"])

    return run


def _group(prefix: Column, n: Column) -> Column:
    return F.xxhash64(prefix, n)


def _tokens(asked=None):
    """The shingles of prefixes, each with its rank and place; only what a filter may hold, if there is one."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) // 8 for x in batch.column("prefix")], np.int64)
            if not sizes.sum():
                continue
            tokens = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("prefix")), np.uint64)
            ranks = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("ranks")), np.uint16)
            of = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            some = np.arange(len(of)) if asked is None else held(asked.value, tokens)
            columns = [pa.array(tokens[some].view(np.int64)), pa.array(ranks[some].astype(np.int32)), pa.array(place[some].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c).take(pa.array(of[some])) for c in ("id", "n", "group")], ["token", "rank", "place", "id", "n", "group"])

    return run


_TOKENS = "token long, rank int, place int, id long, n long, group long"


def _lists(described: DataFrame) -> DataFrame:
    """token, place, id, n, group of the shingles that stand in the prefixes of several sets; of lists with the same sets only that which is first in the order."""
    sets = described.filter("prefix is not null").select("id", "n", "prefix", "ranks", _group(F.col("prefix"), F.col("n")).alias("group"))
    met = sets.mapInArrow(_tokens(), _TOKENS).groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("token")
    shared = keep(counted(met), "prefix-shared")
    asked = described.sparkSession.sparkContext.broadcast(key_filter(shared, "token", rows(shared)))
    every = keep(counted(sets.mapInArrow(_tokens(asked), _TOKENS).join(shared, "token", "left_semi").distinct()), "prefix-tokens")
    asked.destroy()
    members = every.groupBy("token", "rank").agg(F.count("*").alias("many"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("mixed"))
    unsigned = F.col("token").bitwiseXOR(F.lit(-(1 << 63))).alias("unsigned")  # prefixes are in order of unsigned numbers
    kept = members.groupBy("many", "total", "mixed").agg(F.min(F.struct("rank", unsigned, "token")).alias("first")).select(F.col("first.token").alias("token"))
    out = keep(counted(every.join(kept, "token", "left_semi").drop("rank")), "prefix-lists", rows(every))
    drop(shared)
    drop(every)
    return out


def _sets(asked):
    """The sets of the texts whose tag may be asked for, once a task; a few others come along."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            some = batch.column("text").take(pa.array(held(asked.value, np.asarray(batch.column("tag")).view(np.uint64))))
            for texts in slices(some, SLICE):
                every, offs = shingle_sets(texts)
                ids = _set_ids(every, offs)
                new = [i for i, x in enumerate(ids.tolist()) if x not in seen and not seen.add(x)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[new].view(np.int64)), pa.array([every[offs[i] : offs[i + 1]].view(np.int64) for i in new], pa.list_(pa.int64()))], ["id", "hashes"])

    return run


@frugal
def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        x, y = (np.frombuffer(b"".join(v.as_buffer() for v in batch.column(c)), np.uint64).reshape(-1, BITMAP) for c in ("x", "y"))
        a, b = np.asarray(batch.column("m")), np.asarray(batch.column("n"))
        differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        yield batch.filter(pa.array(differ <= a + b - 2 * needed(a, b))).select(["a", "b"])


def _linked(x: str, y: str) -> Column:
    """Whether two sets (columns of arrays) are linked; compared on the JVM, so that no batch of sets is made for Python."""
    return (LEAST + OF) * F.size(F.array_intersect(x, y)) >= LEAST * (F.size(x) + F.size(y))


class _Judge:
    """Decides on pairs of sets; each pair is compared once."""

    def __init__(self, described: DataFrame, texts: DataFrame):
        self.described, self.texts, self.rows = described, texts, rows(described)
        self.traits = keep(described.filter("prefix is not null").select("id", "n", "bits").dropDuplicates(["id"]), "prefix-traits", self.rows)
        self.before: DataFrame | None = None

    def links(self, pairs: DataFrame) -> DataFrame | None:
        """Those of pairs (a, b) that are linked, or None if none are; pairs compared before are left out."""
        if self.before is not None:
            pairs = pairs.join(self.before, ["a", "b"], "left_anti")
        one = self.traits.select(F.col("id").alias("a"), F.col("bits").alias("x"), F.col("n").alias("m"))
        other = self.traits.select(F.col("id").alias("b"), F.col("bits").alias("y"), "n")
        pairs = keep(counted(pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(_plausible, "a long, b long")), "prefix-pairs")
        many = rows(pairs)
        if not many:
            drop(pairs)
            return None
        asked = keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "prefix-asked", 2 * many)
        tags = keep(counted(self.described.filter("prefix is not null").join(asked, "id", "left_semi").select("tag").distinct()), "prefix-tags", self.rows)
        wanted = self.texts.sparkSession.sparkContext.broadcast(key_filter(tags, "tag", rows(tags)))
        sets = keep(self.texts.select("tag", "text").mapInArrow(_sets(wanted), "id long, hashes array<long>").join(asked, "id", "left_semi").dropDuplicates(["id"]), "prefix-sets", 2 * many)
        wanted.destroy()
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
        judged = keep(counted(both.select("a", "b", _linked("x", "y").alias("near")), F.col("near")), "prefix-judged", many)
        for x in (pairs, asked, tags, sets):
            drop(x)
        self.before = judged.select("a", "b") if self.before is None else self.before.union(judged.select("a", "b"))
        return judged.filter("near").select("a", "b") if rows(judged) else None


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _merged(roots: DataFrame, links: DataFrame | None, most: int) -> DataFrame:
    """roots (id, root; most ids at most) with the groups of links (a, b) put together; ids that roots doesn't have are roots of their own so far."""
    if links is None:
        return roots
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    more = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b")
    upper = components(more)
    above = upper.select(F.col("id").alias("of"), F.col("root").alias("above"))
    ids = roots.union(above.select("of", "of")).dropDuplicates(["id"])
    out = keep(ids.join(above, ids.root == above.of, "left").select("id", F.coalesce("above", "root").alias("root")), "prefix-roots", most)
    drop(upper)
    sweep(roots.sparkSession)
    return out


def _pairs_of(most: int | None):
    """Pairs of sets of a list, or of two pieces of one, that are in different components and may be linked: groups that pass, expanded; the nearest most pairs of each two components."""

    def run(table: pa.Table) -> pa.Table:
        n, place, group, root, ids, piece = (np.asarray(table.column(c)) for c in ("n", "place", "group", "root", "id", "piece"))
        bits = np.frombuffer(b"".join(v.as_buffer() for v in table.column("bits")), np.uint64).reshape(-1, BITMAP)
        _, first, of = np.unique(group, return_index=True, return_inverse=True)
        size, rest = n[first], n[first] - place[first]
        out: list[tuple] = []
        low = piece == piece.min()
        rows, columns = (np.flatnonzero(low), np.flatnonzero(~low)) if piece.max() > piece.min() else (np.arange(len(n)),) * 2
        alone = rows is columns
        for i in rows.tolist():
            g = of[i]
            passes = np.minimum(rest, rest[g]) >= needed(size, size[g])
            j = columns[passes[of[columns]] & (root[columns] != root[i])]
            j = j[ids[j] > ids[i]] if alone else j
            if len(j):
                differ = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
                near = differ <= n[j] + n[i] - 2 * needed(n[j], n[i])
                out.append((np.full(int(near.sum()), i), j[near], differ[near]))
        if not out:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j, differ = map(np.concatenate, zip(*out, strict=True))
        if most is not None:
            one, two = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            order = np.lexsort((differ, two, one))
            new = np.ones(len(order), bool)
            new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            begin = np.flatnonzero(new)
            nearest = order[np.arange(len(order)) - begin[np.cumsum(new) - 1] < most]
            i, j = i[nearest], j[nearest]
        return pa.table({"a": pa.array(np.minimum(ids[i], ids[j])), "b": pa.array(np.maximum(ids[i], ids[j]))})

    return run


def _apart(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """lists, with the root of each set, as far as their sets aren't all connected."""
    many = rows(lists)
    placed = keep(lists.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "prefix-placed", many)
    apart = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many")).filter("low < high").select("token", "many")
    out = keep(counted(placed.join(apart, "token")), "prefix-apart", many)
    drop(placed)
    return out


def _within(lists: DataFrame, traits: DataFrame, most: int | None) -> DataFrame:
    """Pairs (a, b) of sets in lists that may be linked and aren't connected."""
    pieces = F.ceil(F.col("many") / PIECE).cast("int")
    own = F.pmod(F.xxhash64("id"), pieces).cast("int")
    placed = lists.withColumns({"pieces": pieces, "piece": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    keys = ["token", F.least("piece", "other").alias("one"), F.greatest("piece", "other").alias("two")]
    joined = placed.join(traits.select("id", "bits"), "id").select("token", "piece", "other", "id", "root", "n", "place", "group", "bits")
    return joined.groupBy(*keys).applyInArrow(_pairs_of(most), "a long, b long").distinct()


def _roots(described: DataFrame, texts: DataFrame, near: DataFrame | None) -> DataFrame:
    """id, root of every set that is linked to another one; pairs (a, b) of near are compared first."""
    every = lists = _lists(described)
    judge, many = _Judge(described, texts), rows(every)
    roots = described.sparkSession.createDataFrame([], "id long, root long")
    if near is not None:
        # what these links connect needs no list
        roots = _merged(roots, judge.links(near), judge.rows)
        apart = _apart(every, roots)
        lists, many = apart.drop("root", "many"), rows(apart)
    weight = lists.join(lists.groupBy("token").agg(F.count("*").alias("many")), "token").groupBy("id").agg(F.sum("many").alias("weight"))
    weighed = keep(lists.join(weight, "id"), "prefix-weighed", many)
    lead = weighed.groupBy("token").agg(F.max(F.struct("weight", "id", "n", "place")).alias("lead"))
    fits = F.expr(f"{LEAST + OF} * least(n - place, lead.n - lead.place) >= {LEAST} * (n + lead.n)")
    star = weighed.join(lead, "token").filter(F.col("id") != F.col("lead.id")).filter(fits).select(*_ordered(F.col("id"), F.col("lead.id"))).distinct()
    roots = _merged(roots, judge.links(star), judge.rows)
    drop(weighed)
    for most in (FIRST, None):
        apart = _apart(every, roots)
        if not rows(apart):
            drop(apart)
            break
        within = keep(_within(apart, judge.traits, most), "prefix-within")
        roots = _merged(roots, judge.links(within), judge.rows)
        for x in (apart, within):
            drop(x)
    drop(every)
    drop(judge.traits)
    return roots


def grouped(docs: DataFrame, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, tag (hash of the text), n (size of its set), root (the group) and component_id of every row of docs (doc_id, text); rows without words are one group.

    near gives, of the rows' tag, id (of its set) and n, pairs (a, b) of sets by another method; they are compared first, and what they connect needs no further comparison.
    """
    with narrow(docs.sparkSession):
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
        tally = docs.sparkSession.sparkContext.broadcast(tallies(texts))
        described = keep(counted(texts.mapInArrow(_described(tally), "doc_id long, tag long, id long, n long, prefix binary, ranks binary, bits binary")), "prefix-described")
        tally.destroy()
        roots = _roots(described, texts, near(described.select("tag", "id", "n")) if near else None)
        many = rows(described)
        known = keep(described.groupBy("id").agg(F.min("doc_id").alias("least")).join(roots, "id", "left").select("id", "least", F.coalesce("root", "id").alias("root")), "prefix-known", many)
        least = known.groupBy("root").agg(F.min("least").alias("component_id"))
        member = keep(known.join(least, "root").select("id", "root", "component_id"), "prefix-components", many)
        drop(known)
        drop(roots)
        return described.select("doc_id", "tag", "n", "id").join(member, "id").select("doc_id", "tag", "n", "root", "component_id")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id in reach by links) of every row of docs (doc_id, text).

    Null texts and texts without words have no shingles and are linked with nothing: their component is their own doc_id. Repeated
    rows and texts with equal sets are linked; texts of any length count whole. A null doc_id is never the smallest unless there is no
    other; no rows give no rows; other columns are ignored. Shingles are compared by 64-bit hashes.
    """
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
