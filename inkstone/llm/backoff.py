"""Stupid-backoff scores of documents under a bigram model of the whole corpus.

A word is scored by all of the corpus but its own occurrence, as that is no evidence for it: with c' = c - 1 and N' = N - 1,
S(w | v) = c'(v w) / c'(v) if c'(v w) > 0, else 0.4 * S(w); S(w) = c'(w) / N' if c'(w) > 0, else 0.4 / N'. The first word
of a document has S(w). So every bigram counts, and one that occurs nowhere else backs off. Scores are summed in millionths
of ln, each logarithm rounded by itself, so sums are exact in any order.

Count tables are partitioned by word hash. The exploded bigrams of all documents go to the partition of their
second word, where c(w) and c(v w) are counted; what is still missing, c(v), is asked of the table of
single words, which is partitioned alike. Words that make up a large part of a partition (HOT) are spread
over all partitions by their first word; their exact counts, of which there is a bounded number, are known
everywhere (MOST_HOT at most). Rows hold packed arrays of one partition and one batch of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import hash_of, mix, slices
from .packing import ROWS, SCHEMA, by_part, pack, rows, unpack
from .scratch import keep, settled

ALPHA, MILLION = 0.4, 1e6
#: Word hashes have 48 bits; 0 stands for the start of a document.
_MASK = np.uint64((1 << 48) - 1)
#: Bigrams in a partition, about, and the part of it from which on a word is hot.
PARTITION, HOT = 3 << 19, 16
#: Hot words at most (16 MB).
MOST_HOT = 1 << 20
#: Partitions at least.
LEAST_PARTS = 96
#: Text bytes whose bigrams are packed together.
PACK_BYTES = 8 << 20


def _micro(x) -> np.ndarray:
    return np.floor(np.log(x) * MILLION + 0.5).astype(np.int64)


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Index of the first document, word hashes and word offsets of runs of documents."""
    for texts in slices(column):
        starts, ends, offs = texts.words()
        h = hash_of(texts.prefix(), starts, ends) & _MASK
        yield texts.first, np.maximum(h, np.uint64(1)), offs


def _part(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _singles(parts: int):
    """Distinct words of runs of documents with their counts, by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
            to = _part(words, parts)
            order = np.argsort(to, kind="stable")
            words, counts, to = words[order], counts[order], to[order]
            return rows([(p, _COUNTS, pack(("p6", words[s]), ("<i8", counts[s]))) for p, s in by_part(to, parts)])

        for batch in batches:
            for _, words, _ in _words(batch.column("text")):
                held.append(np.unique(words, return_counts=True))
                if sum(len(w) for w, _ in held) > 1 << 20:
                    yield flush()
                    held = []
        if held and sum(len(w) for w, _ in held):
            yield flush()

    return run


def _table(group: pa.Table) -> pa.Table:
    """The count table of one partition."""
    got = [unpack(x.as_py(), "p6", "<i8") for x in group.column("blob")]
    words, at = np.unique(np.concatenate([w for w, _ in got]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([c for _, c in got])).astype(np.int64)
    return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "kind": pa.array([_COUNTS], pa.int32()), "blob": pa.array([pack(("p6", words), ("<i8", counts))], pa.binary()), "total": pa.array([int(counts.sum())], pa.int64())})


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                words, counts = unpack(blob.as_py(), "p6", "<i8")
                at = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(words[at].astype(np.int64)), pa.array(counts[at])], ["word", "n"])

    return run


#: Kinds of packed rows: count table, bigrams, what is asked of a count table, sums by document, documents.
_COUNTS, _BIGRAMS, _ASKED, _SUMS, _ROWS = range(5)
_SUM_KINDS = ("<i8", "p8", "<u4", "<u4")
_BIGRAM_KINDS = ("p6", "<i4", "p6", "p3", "<i8", "p3")
_ASKED_KINDS = ("p6", "<i4", "<i8", "p3")
#: Documents with neighbouring numbers whose sums go to one partition.
_NEAR = 10


def _doc_part(docs: np.ndarray, parts: int) -> np.ndarray:
    return _part(mix((docs >> _NEAR).view(np.uint64)), parts)


def _bigrams(parts: int, shared):
    """The bigrams of runs of documents by the partition of their second word (a hot one: of both words), and the documents.

    Documents are numbered by task and place in it, so that the numbers of neighbours differ little.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        hot = shared.value[0]
        base = TaskContext.get().partitionId() << 40

        def flush() -> pa.RecordBatch:
            second, first, doc = (np.concatenate([x[k] for x in held]) for k in range(3))
            held.clear()
            to = _part(second, parts)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, second), len(hot) - 1)
                spread = hot[at] == second
                to[spread] = _part(mix(first[spread] + second[spread] * np.uint64(3)) & _MASK, parts)
            order = np.lexsort((second, to))
            to = to[order]
            found = []
            for p, s in by_part(to, parts):
                o = order[s]
                w = second[o]
                at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                own, local = np.unique(doc[o], return_inverse=True)
                before, place = np.unique(first[o], return_inverse=True)
                found.append((p, _BIGRAMS, pack(("p6", w[at]), ("<i4", np.diff(np.append(at, len(w)))), ("p6", before), ("p3", place), ("<i8", np.diff(own, prepend=0)), ("p3", local))))
            return rows(found)

        size = n = 0
        for batch in batches:
            ids = batch.column("doc_id")
            numbers = base + n + np.arange(len(ids))
            to = _doc_part(numbers, parts)
            order = np.argsort(to, kind="stable")
            none = np.asarray(ids.is_null())
            known = np.asarray(ids.fill_null(0))
            yield rows([(parts + p, _ROWS, pack(("<i8", numbers[o := order[s]]), ("<i8", known[o]), ("<u1", none[o]))) for p, s in by_part(to[order], parts)])
            for first, words, offs in _words(batch.column("text")):
                before = np.zeros(len(words), np.uint64)
                before[1:] = words[:-1]
                before[offs[:-1][np.diff(offs) > 0]] = 0
                held.append((words, before, np.repeat(numbers[first : first + len(offs) - 1], np.diff(offs))))
                size += len(words) * 6
                if size >= PACK_BYTES:
                    yield flush()
                    size = 0
            n += len(ids)
        if size:
            yield flush()

    return run


def _sums(key: np.ndarray, doc: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    own, at = np.unique(key, return_inverse=True)
    return [own, *(np.bincount(at[doc], v, len(own)).astype(np.int64) for v in values)]


def _packed_sums(own: np.ndarray, micro: np.ndarray, words: np.ndarray, kept: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Sums by document (own, ascending) as packed rows of the documents' partitions."""
    to = _doc_part(own, parts)
    order = np.argsort(to, kind="stable")
    own, micro, words, kept, to = own[order], micro[order], words[order], kept[order], to[order]
    return [(p, _SUMS, pack(("<i8", np.diff(own[s], prepend=0)), ("p8", micro[s].view(np.uint64)), ("<u4", words[s]), ("<u4", kept[s]))) for p, s in by_part(to, parts)]


def _moved(group: pa.Table, parts: int) -> pa.Table:
    return pa.table([pa.array([p - parts for p in group.column("part").to_pylist()], pa.int32()), group.column("kind"), group.column("blob")], schema=SCHEMA)


def _score(parts: int, total: int, shared):
    """Count the words and bigrams of one partition and score its bigrams, all but for c(v) of words that are not hot."""

    def known(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hot, hot_counts = shared.value
        if not len(hot):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        return hot[at] == words, hot_counts[at]

    def run(group: pa.Table) -> pa.Table:
        if group.column("part")[0].as_py() >= parts:
            return _moved(group, parts)
        got = [unpack(x.as_py(), *_BIGRAM_KINDS) for x in group.column("blob")]
        second = np.concatenate([np.repeat(x[0], x[1]) for x in got])
        first = np.concatenate([x[2][x[3].astype(np.int64)] for x in got])
        base = np.cumsum([0, *(len(x[4]) for x in got)])
        key = np.concatenate([np.cumsum(x[4]) for x in got])
        doc = np.concatenate([x[5].astype(np.int64) + b for x, b in zip(got, base, strict=False)])
        del got
        _, at, n = np.unique(mix(first * np.uint64(0x9E3779B97F4A7C15) ^ (second << np.uint64(16))), return_inverse=True, return_counts=True)
        pair = n[at]
        _, at, n = np.unique(second, return_inverse=True, return_counts=True)
        single = n[at]
        is_hot, n = known(second)
        single = np.where(is_hot, n, single)
        begins = first == 0
        full = ~begins & (pair > 1)
        alone = np.where(single > 1, _micro(np.maximum(single - 1, 1)), int(_micro(ALPHA))) - int(_micro(float(max(1, total - 1))))
        micro = np.where(full, _micro(np.maximum(pair - 1, 1)), alone + np.where(begins, 0, int(_micro(ALPHA))))
        first_hot, n = known(first)
        micro = micro - np.where(full & first_hot, _micro(np.maximum(n - 1, 1)), 0)
        out = _packed_sums(*_sums(key, doc, micro, np.ones(len(doc)), full), parts)
        ask = np.flatnonzero(full & ~first_hot)
        to = _part(first[ask], parts)
        order = np.lexsort((first[ask], to))
        ask, to = ask[order], to[order]
        for p, s in by_part(to, parts):
            docs, local = np.unique(key[doc[ask[s]]], return_inverse=True)
            words = first[ask[s]]
            at = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
            out.append((p, _ASKED, pack(("p6", words[at]), ("<i4", np.diff(np.append(at, len(words)))), ("<i8", np.diff(docs, prepend=0)), ("p3", local))))
        return pa.Table.from_batches([rows(out)])

    return run


def _answer(parts: int):
    """What documents lose for c(v), from the count table of a partition and what was asked of it."""

    def run(group: pa.Table) -> pa.Table:
        kinds, blobs = group.column("kind").to_pylist(), [x.as_py() for x in group.column("blob")]
        table = next((unpack(b, "p6", "<i8") for k, b in zip(kinds, blobs, strict=True) if k == _COUNTS), None)
        asked = [unpack(b, *_ASKED_KINDS) for k, b in zip(kinds, blobs, strict=True) if k == _ASKED]
        if not asked:
            return pa.Table.from_batches([rows([])])
        lost = _micro(np.maximum(table[1] - 1, 1))
        sums = [_sums(np.cumsum(docs), local.astype(np.int64), -np.repeat(lost[np.searchsorted(table[0], words)], runs)) for words, runs, docs, local in asked]
        own = np.concatenate([k for k, _ in sums])
        own, micro = _sums(own, np.arange(len(own)), np.concatenate([m for _, m in sums]))
        zero = np.zeros(len(own), np.int64)
        return pa.Table.from_batches([rows(_packed_sums(own, micro, zero, zero, parts))])

    return run


_OUT = "doc_id long, n_words long, n_bigrams long, score double"


def _total(group: pa.Table) -> pa.Table:
    """The documents of a partition with their sums."""
    kinds, blobs = group.column("kind").to_pylist(), [x.as_py() for x in group.column("blob")]
    docs = [unpack(b, "<i8", "<i8", "<u1") for k, b in zip(kinds, blobs, strict=True) if k == _ROWS]
    got = [unpack(b, *_SUM_KINDS) for k, b in zip(kinds, blobs, strict=True) if k == _SUMS]
    number, ids, none = (np.concatenate([x[k] for x in docs]) for k in range(3))
    order = np.argsort(number)
    number, ids, none = number[order], ids[order], none[order].astype(bool)
    at = np.searchsorted(number, np.concatenate([np.zeros(0, np.int64), *(np.cumsum(x[0]) for x in got)]))
    micro = np.bincount(at, np.concatenate([np.zeros(0), *(x[1].view(np.int64) for x in got)]), len(number))
    words, kept = (np.bincount(at, np.concatenate([np.zeros(0), *(x[k] for x in got)]), len(number)).astype(np.int64) for k in (2, 3))
    score = pa.array(micro / np.maximum(words * MILLION, 1), mask=words == 0)
    return pa.table({"doc_id": pa.array(ids, mask=none), "n_words": words, "n_bigrams": kept, "score": score})


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_bigrams, score of every row of docs (doc_id, text); score is the mean ln S of its words.

    n_bigrams is the number of words scored by a bigram. Words are runs of other than ASCII white space. A null
    or empty text has no words and a null score; repeated rows count each time in the model and get equal scores;
    texts of any length count whole; no rows give no rows; other columns are ignored.
    """
    text = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "lm-documents")
    size = text.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-size // (6 * PARTITION)))
    singles = text.select("text").mapInArrow(_singles(parts), ROWS)
    table = keep(singles.groupBy("part").applyInArrow(_table, f"{ROWS}, total long"), "lm-words")
    total = table.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    least = max(2, -(-total // min(parts * HOT, MOST_HOT)))
    frequent = table.select("blob").mapInArrow(_frequent(least), "word long, n long").orderBy("word").toArrow()  # at most parts * HOT rows, and MOST_HOT
    hot = np.asarray(frequent.column("word")).astype(np.uint64), np.asarray(frequent.column("n"))
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    packed = text.mapInArrow(_bigrams(parts, shared), ROWS)
    scored = keep(packed.groupBy("part").applyInArrow(_score(parts, max(1, total), shared), ROWS), "lm-scores")
    asked = scored.filter(F.col("kind") == _ASKED).union(table.select("part", "kind", "blob"))
    answers = asked.groupBy("part").applyInArrow(_answer(parts), ROWS)
    return scored.filter(F.col("kind").isin(_SUMS, _ROWS)).union(answers).groupBy("part").applyInArrow(_total, _OUT)
