"""Vector bin packing of documents into shards.

Bytes, words and rows are balanced jointly: each group goes to the shard whose residual capacity has
the largest dot product with the group's size vector. Groups are the copies of one text.

* A group with more than 1/FINE of a shard in some dimension is a large group. There can be only 3 * FINE * shards
  of them, so they are packed first, on the driver. One with more than 1/COARSE of a shard is cut into pieces of at most about
  that size, as many for each shard, by a hash of the row, so a text that makes up a third of the rows is spread evenly, whatever its ids.
* All other groups, a row each, are dealt to parts by a hash of their text, each part with the same share of every shard's residual
  capacity. A part packs its groups one by one, largest first, in one task. Parts are independent of each other; each
  ends with its smallest groups, so what parts leave uneven is small and has no direction.
* Rows take the shard of their group or piece, and slots by shard and part of the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, keep

#: Large groups exceed this fraction of a shard.
FINE = 64
#: Groups that exceed this fraction of a shard are cut.
COARSE = 8
#: Groups that are packed together, and rows that are numbered together, about.
PART_GROUPS, PART_ROWS = 200_000, 200_000
#: Weights of bytes, words and rows. Equal bytes are the law, so they count most.
WEIGHTS = (3.0, 1.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"

def pack(vectors: np.ndarray, shards: int, weights: tuple[float, ...] = (1.0, 1.0, 1.0), room: np.ndarray | None = None) -> np.ndarray:
    """The shard of each item: largest items first, each where its dot product with the residual capacity is highest.

    vectors has a row per item and a column per dimension; both the items and the capacities are measured in
    weights of the totals. room: the share of the totals that each shard takes (a row each), the same for all if not given.
    Ties take the lowest shard.
    """
    total = vectors.sum(0)
    v = vectors / np.where(total > 0, total, 1) * weights
    room = (np.full((shards, v.shape[1]), 1 / max(1, shards)) if room is None else room) * weights
    out = np.zeros(len(v), np.int64)
    for i in np.argsort(-v.max(1), kind="stable") if len(v) else []:
        out[i] = s = int(np.argmax(room @ v[i]))
        room[s] -= v[i]
    return out


def _pack_part(shards: int, room: np.ndarray):
    """The shard of each group of a part."""

    def run(groups: pa.Table) -> pa.Table:
        key, crc, size, n, words = (np.asarray(groups.column(c)) for c in ("key", "text_crc32", "size", "n", "w"))
        order = np.lexsort((size, crc, key))
        shard = np.empty(len(order), np.int32)
        shard[order] = pack((np.stack([size, words, np.ones(len(n))], 1) * n[:, None])[order], shards, WEIGHTS, room)
        return pa.table({"key": key, "text_crc32": crc, "size": size, "shard": shard})

    return run


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text).

    A null text counts as empty (size 8), texts of any length count whole; a null doc_id is placed like any other; repeated rows, and rows with
    one doc_id or none, each get a slot of their own and are spread like others; no rows give no rows; other columns are ignored. Slots of a
    shard are 0, 1, 2, ... without gaps. law is 'bytes': shards have nearly equal sizes, and words and rows are balanced as well; the rows of
    one text are in one shard, unless they make up more than 1/COARSE of a shard in some dimension. Ties of shards take the lowest.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
            F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("own"),  # tells rows with one doc_id apart
        ),
        "shard-rows",
    )
    group = ["key", "text_crc32", "size"]
    total = np.array([x or 0 for x in rows.agg(F.sum("size"), F.sum("words"), F.count("*")).first()], float)
    bound = [max(1.0, x / (shards * FINE)) for x in total]
    share = F.greatest(F.col("n") * F.col("size") / bound[0], F.col("n") * F.col("w") / bound[1], F.col("n") / bound[2])
    groups = keep(rows.groupBy(*group).agg(F.count("*").alias("n"), F.max("words").alias("w")).withColumn("share", share), "shard-groups")
    # at most 3 * FINE * shards rows, by the definition of bound
    large = groups.filter("share > 1").orderBy(*group).collect()
    pieces = [min(r["n"], 1 if r["share"] * COARSE <= FINE else shards * math.ceil(r["share"] * COARSE / FINE / shards)) for r in large]
    ends = np.cumsum(pieces).tolist()
    table = spark.createDataFrame([(r["key"], r["text_crc32"], r["size"], r["w"], p, e - p) for r, p, e in zip(large, pieces, ends, strict=True)], "key long, text_crc32 long, size long, w long, pieces int, base int")
    piece = F.col("base") + F.pmod(F.col("own"), F.col("pieces"))
    counted = rows.join(F.broadcast(table), group).groupBy(piece.alias("piece")).agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("w").alias("w"))
    # each large group has fewer than share * COARSE / FINE + shards + 1 pieces, and at most 3 * COARSE * shards groups are cut
    each = np.zeros((sum(pieces), 3))
    for r in counted.collect():
        each[r["piece"]] = r["n"] * r["size"], r["n"] * r["w"], r["n"]
    # shards have room for all rows; the pieces take their part of it
    where = pack(each, shards, WEIGHTS, np.full((shards, 3), 1 / shards) * total / np.maximum(each.sum(0), 1))
    homes = spark.createDataFrame([(r["key"], r["text_crc32"], r["size"], where[e - p : e].tolist()) for r, p, e in zip(large, pieces, ends, strict=True)], "key long, text_crc32 long, size long, shards array<int>")
    # the share of the other rows that each shard still takes
    load = np.zeros((shards, 3))
    np.add.at(load, where, each)
    room = np.maximum(total / shards - load, 0)
    room = room / np.where(room.sum(0) > 0, room.sum(0), 1)
    small = groups.filter("share <= 1")
    parts = max(1, math.ceil(groups.count() / PART_GROUPS))
    packed = small.withColumn("part", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(parts))).groupBy("part").applyInArrow(_pack_part(shards, room), "key long, text_crc32 long, size long, shard int")
    homes_of_small = keep(packed, "shard-homes")
    known = ["doc_id", "size", "text_crc32", "own"]
    at_once = rows.join(F.broadcast(homes), group).select(*known, F.get("shards", F.pmod(F.col("own"), F.size("shards"))).alias("shard"))
    rest = rows.join(F.broadcast(homes.select(*group)), group, "left_anti").join(homes_of_small, group).select(*known, "shard")
    # rows get their slots by shard and part, parts being dealt by row, so that none grows with a group
    slices = max(1, math.ceil(total[2] / PART_ROWS))
    placed = at_once.union(rest).withColumn("part", F.pmod(F.xxhash64("own", F.lit(9)), F.lit(slices)))
    order = Window.partitionBy("shard", "part").orderBy(F.asc_nulls_last("doc_id"), "size", "text_crc32", "own")
    placed = keep(placed.withColumn("turn", F.row_number().over(order) - 1), "shard-placed")
    for x in (rows, groups, homes_of_small):
        drop(x)
    filled = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = keep(filled.select(F.col("shard").alias("of"), F.col("part").alias("in"), before.alias("first")), "shard-first")
    return placed.join(first, (F.col("shard") == F.col("of")) & (F.col("part") == F.col("in"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("turn")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
