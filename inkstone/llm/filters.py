"""A filter of keys for the tasks of a scan: what it holds may be a key, what it doesn't hold is none.

It has a bounded size whatever the number of keys, is filled where the keys are, and only lets through more rows
by mistake when there are many; a join on the key must follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import frugal, mix

#: Bits for each key; bits at least and at most (32 MB), and those of a piece, as powers of two.
KEY_BITS, LEAST_BITS, MOST_BITS, PIECE_BITS = 16, 22, 28, 19


def _slots(key: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(key + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) for k in (1, 2, 3)]


def _pieces(bits: int, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(1 << (bits - 3), np.uint8)
        for batch in made(batches) if made else batches:
            for at in _slots(np.asarray(batch.column("key")).view(np.uint64), bits):
                np.bitwise_or.at(filled, at >> 3, (1 << (at & 7)).astype(np.uint8))
        pieces = filled.reshape(-1, 1 << (PIECE_BITS - 3))
        for i in np.flatnonzero(pieces.any(1)).tolist():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "bits": pa.array([pieces[i].tobytes()], pa.binary())})

    return run


@frugal
def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, bits in zip(batch.column("piece").to_pylist(), batch.column("bits"), strict=True):
            now = np.frombuffer(bits.as_py(), np.uint8)
            total[piece] = total[piece] | now if piece in total else now
    yield pa.RecordBatch.from_pydict({"piece": pa.array(list(total), pa.int32()), "bits": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def key_filter(rows: DataFrame, column: str, about: int | None = None, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> np.ndarray:
    """A filter that holds every value of a long column without nulls: 1 << MOST_BITS bits (32 MB) at most. about: the number of values, if known.

    made makes keys (batches with a column key) of the column, if it isn't them, where the filter is filled: a task with two Python functions, one on the other, has two
    workers, and an executor keeps as many for all that follows.
    """
    keys = rows.select(F.col(column).alias("key"))
    if about is None:
        about = (keys.mapInArrow(made, "key long") if made else keys).count()
    bits = min(MOST_BITS, max(LEAST_BITS, (KEY_BITS * about).bit_length()))
    out = np.zeros((1 << (bits - PIECE_BITS), 1 << (PIECE_BITS - 3)), np.uint8)
    united = keys.mapInArrow(_pieces(bits, made), "piece int, bits binary").repartition("piece").mapInArrow(_united, "piece int, bits binary")
    for r in united.collect():  # at most the pieces of the filter
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def held(filled: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where keys may be in the filter."""
    at = np.arange(len(key))
    for k in range(3):
        slot = _slots(key[at], len(filled).bit_length() + 2)[k]
        at = at[(filled[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
    return at
