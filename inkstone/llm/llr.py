"""Quality rules: a hashed n-gram log-likelihood ratio on top of per-document base rules.

Tokens are runs of letters, digits and bytes beyond ASCII, and runs of punctuation, lower-cased. Their
unigrams and bigrams are hashed to BUCKETS buckets and counted over all documents (raw corpus) and over
all documents labelled good (trusted target). A document's score is the mean over its n-grams of
log p(target) - log p(raw); it is kept from THRESHOLD on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import LOWER, SPACE, Texts, hash_of, mix, roll, slices
from .filters import held, key_filter
from .scratch import drop, keep

BUCKETS = 1 << 17
#: Pieces in which count vectors travel.
PIECES = 64
THRESHOLD, PRIOR = -0.1, 1.0
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30

_KIND = np.where(SPACE, 0, 2).astype(np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
# bytes that begin a code point of a word
_CHAR = ~SPACE
_CHAR[128:192] = False


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, and the token offset of each document."""
    data = LOWER[texts.data]
    kind = _KIND[data]
    n = len(data)
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[texts.offs] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] > 0 if n else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    return hash_of(texts.prefix(data), starts, ends), np.searchsorted(starts, texts.offs)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of unigrams and of bigrams (BUCKETS: the bigram would leave its document), and the token offset of each document."""
    h, offs = tokens(texts)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    pairs = np.full(len(h), BUCKETS, np.int64)
    if len(h) > 1:
        pairs[:-1] = roll(h, 2) >> shift
        last = offs[1:][np.diff(offs) > 0] - 1
        pairs[last] = BUCKETS
    return (h >> shift).astype(np.int64), pairs, offs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of a task's documents by bucket, in PIECES rows."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for texts in slices(batch.column("text")):
            one, two, _ = features(texts)
            total += np.bincount(one, minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS + 1)[:BUCKETS]
    yield pa.RecordBatch.from_pydict({"piece": pa.array(np.arange(PIECES, dtype=np.int32)), "counts": pa.array([x.tobytes() for x in total.reshape(PIECES, -1)], pa.binary())})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for kind, piece, counts in zip(batch.column("kind").to_pylist(), batch.column("piece").to_pylist(), batch.column("counts"), strict=True):
            v = np.frombuffer(counts.as_py(), np.int64)
            total[kind, piece] = total[kind, piece] + v if (kind, piece) in total else v
    yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in total], pa.int32()), "piece": pa.array([p for _, p in total], pa.int32()), "counts": pa.array([v.tobytes() for v in total.values()], pa.binary())})


def _likely(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(held(shared.value, np.asarray(batch.column("doc_id")).view(np.uint64))))

    return run


def weights(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket, counted over all of docs; zero throughout if nothing is labelled good.

    The raw corpus is counted where it is read. Labels meet their documents by id; a filter of the good ids goes first,
    so only texts that are labelled good, and few others, are exchanged for it.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = keep(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "llr-good")
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(good, "doc_id"))
    trusted = text.filter("doc_id is not null").mapInArrow(_likely(shared), "doc_id long, text string").join(good, "doc_id", "left_semi")
    vectors = [d.select("text").mapInArrow(_count, "piece int, counts binary").withColumn("kind", F.lit(k)) for k, d in enumerate((text, trusted))]
    found = vectors[0].union(vectors[1]).repartition("kind", "piece").mapInArrow(_add, "kind int, piece int, counts binary").collect()  # 2 * PIECES rows, 2 MB together
    drop(good)
    counts = np.zeros((2, PIECES, BUCKETS // PIECES), np.int64)
    for r in found:
        counts[r["kind"], r["piece"]] = np.frombuffer(r["counts"], np.int64)
    raw, target = counts.reshape(2, BUCKETS).astype(float)
    if not target.sum():
        return np.zeros(BUCKETS)
    # smoothed by PRIOR counts in the target and as many, at its size, in the raw corpus: buckets that both hardly know tell nothing
    expected = raw * (target.sum() / raw.sum())
    return np.log(target + PRIOR) - np.log(expected + PRIOR)


def scores(texts: Texts, weight: np.ndarray) -> np.ndarray:
    """Mean log-likelihood ratio per n-gram of each document; 0 without n-grams."""
    one, two, offs = features(texts)
    w = np.append(weight, 0.0)
    sums = np.concatenate(([0.0], np.cumsum(w[one] + w[two])))
    n = np.diff(offs)
    return (sums[offs[1:]] - sums[offs[:-1]]) / np.maximum(1, 2 * n - 1)


def _within(positions: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(positions, offs))


def _groups(keys: np.ndarray) -> np.ndarray:
    """For each key whether an equal one exists."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def base(texts: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    data, offs, docs = texts.data, texts.offs, len(texts)
    starts, ends, word_offs = texts.words()
    prefix = texts.prefix()
    salt = mix(np.arange(1, docs + 1, dtype=np.uint64))
    # windows of words
    repeated = np.zeros(docs, np.int64)
    if len(starts) >= WINDOW:
        owner = np.repeat(np.arange(docs), np.diff(word_offs))
        at = np.flatnonzero(owner[WINDOW - 1 :] == owner[: len(owner) - WINDOW + 1])
        twice = at[_groups(roll(hash_of(prefix, starts, ends), WINDOW)[at] ^ salt[owner[at]])] if len(at) else at
        step = np.zeros(len(starts) + 1, np.int64)
        np.add.at(step, twice, 1)
        np.add.at(step, twice + WINDOW, -1)
        repeated = _within(np.flatnonzero(np.cumsum(step[:-1]) > 0), word_offs)
    # lines
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = data == 10
    cut[offs] = True
    begin = np.flatnonzero(cut)
    begin, stop = begin[:-1], begin[1:]
    stop = np.where((stop > begin) & (data[stop - 1] == 10), stop - 1, stop) if len(data) else stop
    full = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[full], stop[full]
    line_offs = np.searchsorted(begin, offs)
    lines = hash_of(prefix, begin, stop) ^ np.repeat(salt, np.diff(line_offs))
    order = np.argsort(lines, kind="stable")
    again = np.sort(order[1:][lines[order][1:] == lines[order][:-1]])
    return {
        "n_words": np.diff(word_offs),
        "word_chars": _within(np.flatnonzero(_CHAR[data]), offs),
        "n_symbols": _within(np.flatnonzero(_SYMBOL[data]), offs),
        "n_dup_lines": _within(again, line_offs),
        "n_repeat_words": repeated,
    }


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, base_failed, kept and llr of every row of docs (doc_id, text), given labels (doc_id, quality).

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike and counted
    each time. A document labelled more than once is trusted if one label says so. Without trusted documents all
    scores are 0, so only the base rules decide. Texts of any length are counted and scored whole; a score at the threshold is kept. No rows give no
    rows; other columns are ignored.
    """
    weight = docs.sparkSession.sparkContext.broadcast(weights(docs, labels))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                n = base(texts)
                score = scores(texts, weight.value)
                failed = (n["n_words"] < LEAST_WORDS) | (100 * n["n_repeat_words"] > MOST_REPEATED * n["n_words"])
                ids = batch.column("doc_id").slice(texts.first, len(texts)).cast(pa.int64())
                columns = [ids, *(pa.array(v, pa.int64()) for v in n.values()), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _OUT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)
