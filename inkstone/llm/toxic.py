"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of hashed ones: that of the word and those of its first few bytes, so that an
inflected or compounded word is known by its stem. Filters over 1, 2 and 3 words are max-pooled over the whole
text and a logistic layer turns them into a score.

Training reads all labelled rows that are not held out. They are packed in batches, once. In each round every block of
batches trains a copy of the parameters where it lies, and the copies' changes are averaged: those of an embedding over
the blocks that touched it. Changes are summed as whole numbers, so their order doesn't matter. The round is taken after
which a tenth of the rows, that nothing learns from, is scored best. On another part thresholds are calibrated by
language, from counts of all its scores; the language is no input of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import LOWER, SPACE, Texts, each, frugal, hash_of, mix, slices  # noqa: F401
from .packing import ROWS, pack, rows, unpack
from .scratch import drop, keep

#: Text bytes that are scored at a time.
SLICE = 1 << 19
#: Labelled rows that one copy of the parameters learns from between two averages, and those of one step.
BLOCK, BATCH = 4096, 64
#: Embeddings whose changes are summed together; whole numbers that a change of 1 is, and a score of 1 in calibration.
PIECE, UNIT, GRID = 512, 1 << 24, 1 << 16
#: Embeddings exist for hash buckets that this many training documents have; others have the zero embedding.
LEAST_DOCS = 20
BUCKET_BITS = 20
WIDTHS = (1, 2, 3)
#: Bytes of the beginnings that have an embedding of their own, if the word goes on.
STEMS = (4, 5, 6, 7, 8)
FILTERS, DIM = 8, 12
#: Rounds (and passes over the rows) and steps of BATCH documents, at least.
EPOCHS, STEPS, RATE, DECAY = 10, 400, 0.02, 1e-4
#: Hundredths of the rows on which thresholds are calibrated, and on which training is stopped.
CALIBRATE, STOP = 15, 10
#: Rate of embeddings, by that of the other parameters: a step changes few of them.
EMB_RATE = 3
PREDICT = 0.7

_LETTER = ~SPACE
_LETTER[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80), *range(0, 9), *range(14, 32)]] = False


_NONE = 1 << BUCKET_BITS


def buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each different word and its stems (a row a word), the row of each word in order, and word offsets.

    Words are runs of letters, digits and bytes beyond ASCII, lower-cased.
    """
    data = LOWER[texts.data]
    starts, ends, offs = texts.runs(_LETTER[data])
    prefix = texts.prefix(data)
    whole, first, at = np.unique(hash_of(prefix, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    out = np.full((len(whole), 1 + len(STEMS)), _NONE, np.uint32)
    out[:, 0] = whole >> np.uint64(64 - BUCKET_BITS)
    for k, n in enumerate(STEMS, 1):
        longer = e - s > n
        h = mix(hash_of(prefix, s[longer], s[longer] + n) + np.uint64(n))
        out[longer, k] = h >> np.uint64(64 - BUCKET_BITS)
    return out, at, offs


@dataclass
class Model:
    """ids: embedding row of each bucket (0: none); tables: for each width and place in the filter, its value by embedding row."""

    ids: np.ndarray
    tables: list[list[np.ndarray]]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)
    #: The tables side by side, when they are first used.
    wide: np.ndarray | None = None

    def scores(self, words: np.ndarray, at: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Scores of documents given as buckets() gives them."""
        n = np.diff(offs)
        pooled = np.zeros((len(n), len(self.out)), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            # the first embedding is zero, and many words have no long stem
            if self.wide is None:
                self.wide = np.hstack([t for tables in self.tables for t in tables])
            known = self.ids[words]
            summed = np.zeros((len(words) + 1, self.wide.shape[1]), np.float32)
            for c in range(known.shape[1]):
                some_words = np.flatnonzero(known[:, c])
                summed[some_words] += self.wide[known[some_words, c]]
            by_word = [np.ascontiguousarray(x) for x in np.split(summed, summed.shape[1] // FILTERS, axis=1)]
            starts = offs[:-1][some]
            # two blank rows after each document, so that no filter sees two documents
            gap = 2 * np.arange(len(some))
            row = np.full(len(at) + 2 * len(some), len(words))
            row[np.arange(len(at)) + np.repeat(gap, n[some])] = at
            parts = []
            for k, tables in enumerate(self.tables):
                own = by_word[sum(map(len, self.tables[:k])) :][: len(tables)]
                value = own[0][row]
                for place, t in enumerate(own[1:], 1):
                    value[:-place] += t[row[place:]]
                # the blank rows are no place of a filter: those after a document would see the next one
                parts.append(np.maximum.reduceat(value, np.stack([starts + gap, starts + gap + n[some]], 1).ravel(), axis=0)[::2] + self.bias[k * FILTERS : (k + 1) * FILTERS])
            pooled[some] = np.maximum(np.hstack(parts), 0)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -30, 30)))


Sample = tuple[np.ndarray, np.ndarray, int]


def _joined(samples: list[Sample]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (buckets by word, words in order, label) as one run of documents."""
    base = np.cumsum([0, *(len(w) for w, *_ in samples)])
    offs = np.cumsum([0, *(len(at) for _, at, *_ in samples)])
    return np.concatenate([w for w, *_ in samples]), np.concatenate([at + b for (_, at, *_), b in zip(samples, base, strict=False)]), offs


def start(y: np.ndarray, words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Parameters before training: embeddings of words rows (the first one stays zero), filters by width, and the layer above."""
    f = FILTERS * len(WIDTHS)
    p = {
        "emb": rng.normal(0, 0.1, (words + 1, DIM)).astype(np.float32),
        "bias": np.zeros(f, np.float32),
        "out": rng.normal(0, 0.3, f).astype(np.float32),
        "out_bias": np.array([np.log(y.mean() / (1 - y.mean()))], np.float32),
        **{f"w{w}": rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
    }
    p["emb"][0] = 0
    return p


def built(p: dict[str, np.ndarray], ids: np.ndarray) -> Model:
    return Model(ids, [[p["emb"] @ p[f"w{w}"][o] for o in range(w)] for w in WIDTHS], p["bias"].copy(), p["out"].copy(), float(p["out_bias"][0]))


def gradients(p: dict[str, np.ndarray], ids: np.ndarray, samples: list[Sample], y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the mean logistic loss of samples (with words), those of the embeddings apart: their rows and the gradient of each. Without decay."""
    return _gradients(p, ids, *_joined(samples), y)


def _gradients(p: dict[str, np.ndarray], ids: np.ndarray, words: np.ndarray, at: np.ndarray, offs: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The same of documents given as buckets() gives them."""
    many = len(offs) - 1
    g = {k: np.zeros_like(v) for k, v in p.items() if k != "emb"}
    f = FILTERS * len(WIDTHS)
    pieces = np.vstack([ids[words], np.zeros((1, words.shape[1]), np.int32)])  # the last row is a blank
    by_word = p["emb"][pieces].sum(1)
    gap = 2 * np.arange(many)
    row = np.full(len(at) + 2 * many, len(words))
    row[np.arange(len(at)) + np.repeat(gap, np.diff(offs))] = at
    begin, end = offs[:-1] + gap, offs[1:] + gap
    pooled, where = np.empty((many, f), p["out"].dtype), np.empty((many, f), np.int64)
    for k, w in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        # a filter's values lie side by side; a word that occurs again has the same ones
        value = (p[f"w{w}"][0].T @ by_word.T)[:, row]
        for o in range(1, w):
            value[:, :-o] += (p[f"w{w}"][o].T @ by_word.T)[:, row[o:]]
        for d in range(many):
            where[d, cols] = value[:, begin[d] : end[d]].argmax(1) + begin[d]
        pooled[:, cols] = value[np.arange(FILTERS), where[:, cols]]
    z = pooled + p["bias"]
    a = np.maximum(z, 0)
    d_out = (1 / (1 + np.exp(-(a @ p["out"] + p["out_bias"]))) - y) / many
    g["out"] = a.T @ d_out
    g["out_bias"] = np.array([d_out.sum()])
    dz = np.where(z > 0, d_out[:, None] * p["out"], 0)
    g["bias"] = dz.sum(0)
    touched, grads = [], []
    for k, w in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        dk, wk = dz[:, cols], where[:, cols]
        for o in range(w):
            e = by_word[row[wk + o]]  # documents, filters, dim
            g[f"w{w}"][o] = np.einsum("df,dfe->ef", dk, e)
            grad = (dk[:, :, None] * p[f"w{w}"][o].T[None]).reshape(-1, DIM)
            at_pieces = pieces[row[wk + o]].reshape(-1, pieces.shape[1])
            some = np.flatnonzero(at_pieces.ravel())
            touched.append(at_pieces.ravel()[some])
            grads.append(grad[some // pieces.shape[1]])
    every = np.concatenate(touched)
    order = np.argsort(every, kind="stable")
    t, first = np.unique(every[order], return_index=True)
    ge = np.add.reduceat(np.concatenate(grads)[order], first, axis=0) if len(t) else np.zeros((0, DIM), p["emb"].dtype)
    return g, t, ge


@dataclass
class Chunk:
    """Documents given as buckets() gives them, and their labels."""

    words: np.ndarray
    at: np.ndarray
    offs: np.ndarray
    labels: np.ndarray

    @classmethod
    def read(cls, blob: bytes) -> Chunk:
        words, at, offs, labels = unpack(blob, "<u4", "<u4", "<u4", "<u1")
        return cls(words.reshape(-1, 1 + len(STEMS)), at, offs.astype(np.int64), labels)

    def full(self) -> Chunk:
        """Without documents that have no words."""
        n = np.diff(self.offs)
        return Chunk(self.words, self.at, np.append(0, np.cumsum(n[n > 0])), self.labels[n > 0])


def learned(p: dict[str, np.ndarray], ids: np.ndarray, chunks: list[Chunk], turn: int, passes: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The parameters after some passes of Adam over chunks, a step each, in the given round; and which embeddings they touched."""
    rng = np.random.default_rng((7, turn))
    p = {k: v.copy() for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    touched = np.zeros(len(p["emb"]), np.int64)
    chunks = [x for x in (c.full() for c in chunks) if len(x.labels)]
    rate, step = RATE * (1 - turn / EPOCHS), 0
    for _ in range(passes):
        for i in rng.permutation(len(chunks)).tolist():
            c = chunks[i]
            g, t, ge = _gradients(p, ids, c.words, c.at, c.offs, c.labels.astype(np.float32))
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in g:
                decayed = g[k] + DECAY * p[k] if "bias" not in k else g[k]
                m[k] = 0.9 * m[k] + 0.1 * decayed
                s[k] = 0.999 * s[k] + 0.001 * decayed**2
                p[k] -= (rate * fix * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)
            # an embedding's moments have as many steps as it was touched
            touched[t] += 1
            m["emb"][t] = 0.9 * m["emb"][t] + 0.1 * ge
            s["emb"][t] = 0.999 * s["emb"][t] + 0.001 * ge**2
            fixes = np.sqrt(1 - 0.999 ** touched[t]) / (1 - 0.9 ** touched[t])
            p["emb"][t] -= EMB_RATE * rate * fixes[:, None] * m["emb"][t] / (np.sqrt(s["emb"][t]) + 1e-8)
    return p, np.flatnonzero(touched)


def threshold(scores: np.ndarray, labels: np.ndarray, many: np.ndarray | None = None) -> float:
    """The score from which on F1 is highest; the middle of the gap below it, between 0.5 and 0.9. many: how many documents have each score, with labels summed."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.cumsum(np.ones(len(s)) if many is None else many[order]) + labels.sum())
    i = int(np.argmax(f1))
    below = s[i + 1] if i + 1 < len(s) else 0.0
    return float(np.clip((s[i] + below) / 2, 0.5, 0.9))


def calibrate(model: Model, samples: list[Sample], langs: list[str | None]) -> None:
    """Set the model's thresholds by language from samples at hand; languages with fewer than 20 toxic samples (and unknown ones) get that of all."""
    if not samples:
        return
    s, y = model.scores(*_joined(samples)), np.array([t for *_, t in samples])
    lang = np.array([x or "" for x in langs])
    model.thresholds = {None: threshold(s, y) if y.any() else PREDICT}
    for x in np.unique(lang):
        if y[lang == x].sum() >= 20:
            model.thresholds[str(x)] = threshold(s[lang == x], y[lang == x])


_CHUNKS = "kind int, many int, hits int, langs array<string>, blob binary"
_LEARN, _STOP, _CALIBRATE = range(3)


@frugal
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (in order; of those with one id the first), up to BATCH of one kind together, as their different words and their order."""
    last = None
    for batch in batches:
        ids = np.asarray(batch.column("doc_id"))
        if not len(ids):
            continue
        new = np.append(ids[0] != last, ids[1:] != ids[:-1])
        last = ids[-1]
        batch = batch.filter(pa.array(new))
        kinds = np.asarray(batch.column("kind"))
        for kind in np.unique(kinds).tolist():
            own = batch.filter(pa.array(kinds == kind))
            for i in range(0, own.num_rows, BATCH):
                some = own.slice(i, BATCH)
                for texts in slices(some.column("text"), SLICE):
                    of = some.slice(texts.first, len(texts))
                    labels = np.asarray(of.column("toxic"))
                    words, at, offs = buckets(texts)
                    blob = pack(("<u4", words.ravel()), ("<u4", at), ("<u4", offs), ("<u1", labels))
                    one = [[kind], [len(labels)], [int(labels.sum())], [of.column("lang").to_pylist()], [blob]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, (*[pa.int32()] * 3, pa.list_(pa.string()), pa.binary()), strict=True)], ["kind", "many", "hits", "langs", "blob"])


@frugal
def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents each bucket occurs."""
    seen = np.zeros(_NONE + 1, np.int64)
    for batch in batches:
        for blob in batch.column("blob"):
            c = Chunk.read(blob.as_py())
            of = np.repeat(np.arange(len(c.labels), dtype=np.int64), np.diff(c.offs))
            of, word = np.divmod(np.unique(of * len(c.words) + c.at), max(1, len(c.words)))
            each = np.unique((of[:, None] * (_NONE + 1) + c.words[word]).ravel()) % (_NONE + 1)
            seen += np.bincount(each.astype(np.int64), minlength=_NONE + 1)
    seen[_NONE] = 0
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["bucket", "n"])


#: Parts of sums other than those of embeddings: the other parameters, and the loss.
_OTHERS, _LOSS = -1, -2


def _sums(part: int, at: np.ndarray, weight: np.ndarray, values: np.ndarray) -> tuple[int, int, bytes]:
    return part, 0, pack(("<u4", at), ("<i8", weight), ("<i8", values.ravel()))


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters but the embeddings, in rows as wide as an embedding."""
    flat = np.concatenate([p[k].ravel() for k in sorted(p) if k != "emb"]).astype(float)
    return np.append(flat, np.zeros(-len(flat) % DIM)).reshape(-1, DIM)


def _changes(shared, known, turn: int, passes: int):
    """What each block of chunks changes, weighted by its steps, and the loss of the parameters on chunks that nothing learns from."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, ids = shared.value, known.value
        model = built(p, ids)

        def block(chunks: list[Chunk]) -> pa.RecordBatch:
            now, at = learned(p, ids, chunks, turn, passes)
            weight, out = len(chunks), []
            change = np.rint((now["emb"][at].astype(float) - p["emb"][at]) * weight * UNIT).astype(np.int64)
            cuts = np.flatnonzero(np.diff(at // PIECE)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True) if len(at) else ():
                out.append(_sums(int(at[a] // PIECE), at[a:b], np.full(b - a, weight), change[a:b]))
            other = np.rint((_flat(now) - _flat(p)) * weight * UNIT).astype(np.int64)
            return rows([*out, _sums(_OTHERS, np.arange(len(other)), np.full(len(other), weight), other)])

        waiting: list[Chunk] = []
        loss = many = 0
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                c = Chunk.read(blob.as_py())
                if kind == _STOP:
                    s = np.clip(model.scores(c.words, c.at, c.offs), 1e-6, 1 - 1e-6)
                    loss -= int(np.rint(np.log(np.where(c.labels == 1, s, 1 - s)).sum() * UNIT))
                    many += len(s)
                elif turn < EPOCHS:
                    waiting.append(c)
                    if len(waiting) * BATCH >= BLOCK:
                        yield block(waiting)
                        waiting = []
        if waiting:
            yield block(waiting)
        if many:
            yield rows([_sums(_LOSS, np.zeros(1), np.array([many]), np.append(loss, np.zeros(DIM - 1)))])

    return run


@frugal
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a part as one."""
    total: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
            now = unpack(blob.as_py(), "<u4", "<i8", "<i8")
            now[2] = now[2].reshape(-1, DIM)
            if part in total:
                at, where = np.unique(np.concatenate([total[part][0], now[0]]), return_inverse=True)
                sums = [np.zeros((len(at), *x.shape[1:]), np.int64) for x in now[1:]]
                for k, x in enumerate(sums, 1):
                    np.add.at(x, where, np.concatenate([total[part][k], now[k]]))
                now = [at, *sums]
            total[part] = tuple(now)
    yield rows([_sums(part, *x) for part, x in total.items()])


def train(chunks: DataFrame, many: int, hits: int) -> Model:
    """A model from all chunks of the kind that is learned from (many rows, hits of them toxic), as it is best on the kind that stops training."""
    context = chunks.sparkSession.sparkContext
    least = min(LEAST_DOCS, max(1, many // 20))
    counts = chunks.filter(F.col("kind") == _LEARN).mapInArrow(_document_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    known = np.sort(np.asarray(counts.filter(F.col("n") >= least).select("bucket").toArrow().column("bucket")))  # at most all buckets
    ids = np.zeros(_NONE + 1, np.int32)
    ids[known] = np.arange(1, len(known) + 1)
    p = start(np.array([hits / many]), len(known), np.random.default_rng(7))
    passes = max(1, -(-STEPS * BATCH // (EPOCHS * many)))
    places = context.broadcast(ids)
    best: tuple[float, dict[str, np.ndarray]] | None = None
    for turn in range(EPOCHS + 1):
        shared = context.broadcast(p)
        changes = chunks.filter(F.col("kind") != _CALIBRATE).mapInArrow(_changes(shared, places, turn, passes), ROWS).withColumn("salt", F.spark_partition_id() % 64)
        added = changes.repartition("part", "salt").drop("salt").mapInArrow(_added, ROWS).repartition("part").mapInArrow(_added, ROWS)
        now = {k: v.copy() for k, v in p.items()}
        other, loss = _flat(now), None
        for r in added.toArrow().to_pylist():  # at most the model
            at, weight, values = unpack(r["blob"], "<u4", "<i8", "<i8")
            mean = values.reshape(-1, DIM) / weight[:, None] / UNIT
            if r["part"] == _LOSS:
                loss = mean[0, 0]
            elif r["part"] == _OTHERS:
                other[at] += mean
            else:
                now["emb"][at] += mean.astype(np.float32)
        flat, i = other.ravel(), 0
        for k in sorted(p):
            if k != "emb":
                now[k] = flat[i : i + p[k].size].reshape(p[k].shape).astype(np.float32)
                i += p[k].size
        # the loss is that of the parameters before this round; without rows to stop on the last ones are taken
        if turn and (loss is None or best is None or loss < best[0]):
            best = (loss, p)
        shared.unpersist()
        p = now
    return built(best[1], ids)


def _cells(shared):
    """The scores of calibration, as cells of a grid, with their languages and labels, counted."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, langs in zip(batch.column("blob"), batch.column("langs").to_pylist(), strict=True):
                c = Chunk.read(blob.as_py())
                cell = np.rint(shared.value.scores(c.words, c.at, c.offs) * GRID).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x or "" for x in langs]), pa.array(cell), pa.array(c.labels.astype(np.int32))], ["lang", "cell", "toxic"])

    return run


def _threshold_of(group: pa.Table) -> pa.Table:
    cell, many, hits = (np.asarray(group.column(c)) for c in ("cell", "many", "hits"))
    return group.slice(0, 1).select(["every", "lang"]).append_column("least", pa.array([threshold(cell / GRID, hits, many)])).append_column("toxic", pa.array([int(hits.sum())]))


def calibrated(chunks: DataFrame, model: Model) -> dict[str | None, float]:
    """Thresholds by language from all chunks of that kind, as calibrate() sets them, with scores in steps of 1 / GRID."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    cells = chunks.filter(F.col("kind") == _CALIBRATE).mapInArrow(_cells(shared), "lang string, cell int, toxic int").groupBy("lang", "cell").agg(F.count("*").alias("many"), F.sum("toxic").alias("hits"))
    by = cells.withColumn("every", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("lang", F.when(F.col("every"), "").otherwise(F.col("lang")))
    by = by.groupBy("every", "lang", "cell").agg(F.sum("many").alias("many"), F.sum("hits").alias("hits"))
    found = by.groupBy("every", "lang").applyInArrow(_threshold_of, "every boolean, lang string, least double, toxic long")
    out: dict[str | None, float] = {}
    for r in found.filter("every or toxic >= 20").collect():  # one for each language
        out[None if r["every"] else r["lang"]] = r["least"] if r["toxic"] else PREDICT
    return out


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from all labelled rows whose crc32(doc_id) mod 3 is not 1; None if there are not both labels.

    A document labelled more than once is toxic if one label says so; of rows with one doc_id that with the least hash of its text is read.
    """
    one = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max("toxic").cast("int").alias("toxic")).filter(remainder("of") != 1)
    parts = max(1, -(-one.count() // BLOCK))
    has_lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has_lang.alias("lang")).filter(remainder() != 1)
    joined = texts.repartition(parts, "doc_id").join(one.repartition(parts, "of"), F.col("doc_id") == F.col("of"))
    dice = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(100))
    kind = F.when(dice < CALIBRATE, _CALIBRATE).when(dice < CALIBRATE + STOP, _STOP).otherwise(_LEARN)
    ordered = joined.select("doc_id", "text", "lang", "toxic", kind.alias("kind")).sortWithinPartitions("kind", F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "lang")
    chunks = keep(ordered.mapInArrow(_chunks, _CHUNKS), "toxic-chunks")
    seen = chunks.filter(F.col("kind") == _LEARN).agg(F.coalesce(F.sum("many"), F.lit(0)), F.coalesce(F.sum("hits"), F.lit(0))).first()
    model = train(chunks, *seen) if 0 < seen[1] < seen[0] else None
    if model:
        model.thresholds = calibrated(chunks, model)
    drop(chunks)
    return model


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in the slices in which it is scored."""
    for texts in slices(batch.column("text"), SLICE):
        yield batch.slice(texts.first, len(texts))


def _scorer(docs: DataFrame, model: Model | None):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(0)]
        for texts in slices(batch.column("text"), SLICE):
            out.append(shared.value.scores(*buckets(texts)) if shared.value else np.zeros(len(texts)))
        return np.concatenate(out).astype(float)

    def limits(batch: pa.RecordBatch) -> np.ndarray:
        known = shared.value.thresholds if shared.value else {}
        rest = known.get(None, PREDICT)
        lang = batch.column("lang").to_pylist() if "lang" in batch.schema.names else [None] * batch.num_rows
        return np.array([known.get(x, rest) for x in lang], float)

    return scores, limits


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold, rejected of every row of docs (doc_id, text, lang).

    score is from 0 to 1; predicted is 1 from 0.7 on; rejected says whether it reaches the threshold of the
    row's language. A null or empty text is scored like a text without any telling word; without labels of
    both kinds all scores are 0. Repeated rows are scored alike; a null doc_id is not held out; no rows give no rows.
    """
    scores, limits = _scorer(docs, fit(docs, labels))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = scores(batch), limits(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out")), pa.array(s), pa.array((s >= PREDICT).astype(np.int32)), pa.array(t), pa.array(s >= t)], ["doc_id", "held_out", "score", "predicted", "lang_threshold", "rejected"])

    has_lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has_lang.alias("lang"), F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, lang_threshold double, rejected boolean")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold of their language.

    Null, empty, very long and repeated texts are scored as by scored(), repeated rows stay or go together; an unknown
    or null language, or a table without languages, has the threshold of all; a null doc_id is no reason to go; no
    rows give no rows; columns of docs may have any names.
    """
    scores, limits = _scorer(docs, fit(docs, labels))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                yield part.filter(pa.array(scores(part) < limits(part)))

    return docs.mapInArrow(run, docs.schema)
