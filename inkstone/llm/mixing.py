"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken x = target / source size times. The whole part of x is
taken as it is. The fractions are rounded dependently: of two documents one hands words to the other,
in a random direction whose odds keep every expectation, until one of them is integral (0 or 1 more
copies). Words are conserved, so a source ends within one document of its target.

Documents are dealt to leaves of about LEAF rows; each leaf leaves one residual document, and the
residuals meet FAN leaves at a time in a reduction tree until one per source is left. A source with a
third of all rows simply has more leaves.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

WORD = r"[^\x20\x09-\x0D]+"
#: Source weights by rank, repeating.
WEIGHTS = (5, 2, 1)
#: Documents in a leaf of the reduction tree, and residuals that meet in one node above.
LEAF, FAN = 8192, 4096
SEED = 42

_ROUND = "doc_id long, tag long, source string, size long, source_size long, target double, leaf long, whole long, mass double, more long"


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank (from 0) by code point of source, null last, without gathering them in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = keep(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())  # one row per partition
    first, at = [], 0
    for part, n in counts:
        first.append((part, at))
        at += n
    base = dealt.sparkSession.createDataFrame(first, "part int, base long")
    turn = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(F.broadcast(base), "part").withColumn("rank", F.col("base") + turn - 1).drop("part", "base")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n, target: share of all sizes by weight, none above most times its source's size.

    What a capped source can't take is shared again by weight among the others until none is above. That
    is a level L with target = min(most * size, L * weight), found by raising L until it stands still.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    table = keep(ranked(sources).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)), "mix-targets")
    want = float(share) * float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, seen = 0.0, -1
    while True:
        capped = F.col("cap") < F.col("weight") * level
        r = table.agg(F.sum(F.when(capped, F.col("cap"))).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count_if(capped).alias("n")).first()
        if r["n"] == seen or not r["weight"]:
            break
        seen, level = r["n"], (want - (r["full"] or 0.0)) / r["weight"]
    return table.withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).select("source", "source_size", "n", "target")


def _settle(final: bool, level: int):
    """Round each (source, leaf) of a partition that is sorted by them; the last open row of each stays open unless final.

    Only size, mass and the group of each row are looked at; batches go on with what was decided in place of mass and more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[pa.RecordBatch, int, float] | None = None  # batch of one row, its size and its mass
        group, dice = None, None

        def closed() -> Iterator[pa.RecordBatch]:
            if open_ is not None:
                row, size, mass = open_
                yield _decided(row, [mass], [int(2 * mass >= size) if final else None])

        for batch in batches:
            sizes, masses = batch.column("size").to_pylist(), batch.column("mass").to_pylist()
            sources, leaves = batch.column("source").to_pylist(), batch.column("leaf").to_pylist()
            more: list[int | None] = [None] * len(sizes)
            at = None  # place of the open row in this batch
            for i, (s, u) in enumerate(zip(sizes, masses, strict=True)):
                key = (sources[i], leaves[i])
                if key != group or dice is None:
                    if at is not None:
                        more[at] = int(2 * masses[at] >= sizes[at]) if final else None
                        if more[at] is None:
                            more[at] = _OPEN
                    else:
                        yield from closed()
                    open_, at, group, dice = None, None, key, random.Random(f"{SEED}|{level}|{leaves[i]}|{sources[i]}")
                if u <= 0 or u >= s:
                    # also rows without words, for which 0 or 1 copies are the same number of words
                    more[i] = int(s > 0 and u >= s)
                    continue
                if at is None and open_ is None:
                    at = i
                    continue
                size_a, mass_a = (sizes[at], masses[at]) if at is not None else open_[1:]
                to_a, to_b = min(size_a - mass_a, u), min(mass_a, s - u)
                if dice.random() * (to_a + to_b) < to_b:
                    mass_a, mass_b = (float(size_a) if to_a == size_a - mass_a else mass_a + to_a), (0.0 if to_a == u else u - to_a)
                else:
                    mass_a, mass_b = (0.0 if to_b == mass_a else mass_a - to_b), (float(s) if to_b == s - u else u + to_b)
                done_a, done_b = (None if 0 < m < n else int(m > 0) for m, n in ((mass_a, size_a), (mass_b, s)))
                masses[i], more[i] = mass_b, done_b
                if at is not None:
                    masses[at], more[at] = mass_a, done_a
                elif done_a is not None:
                    yield _decided(open_[0], [mass_a], [done_a])
                else:
                    open_ = (open_[0], size_a, mass_a)
                if done_a is not None:
                    open_, at = None, None if done_b is not None else i
            if at is not None:
                open_ = (batch.slice(at, 1), sizes[at], masses[at])
            stays = [k for k in range(len(sizes)) if k != at]
            yield _decided(batch.take(pa.array(stays, pa.int64())), [masses[k] for k in stays], [None if more[k] == _OPEN else more[k] for k in stays])
        yield from closed()

    return run


_OPEN = -1


def _decided(rows: pa.RecordBatch, mass: list[float], more: list[int | None]) -> pa.RecordBatch:
    names = rows.schema.names
    columns = {**{c: rows.column(c) for c in names}, "mass": pa.array(mass, pa.float64()), "more": pa.array(more, pa.int64())}
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, tag (of the text), source, size, source_size, target, taken, copies for every row of docs (doc_id, text, source).

    A null text has no words; a null source is a source of its own, last in order; repeated rows are
    rounded one by one; no rows give no rows; other columns are ignored. taken is copies * size, at most
    most * size. A text of any length counts all its words; rows that are equal are interchangeable.
    The same rows give the same result, in whatever order or files they come.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.col("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "mix-rows")
    sources = keep(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), share, most), "mix-shares")
    leaves = F.ceil(F.col("n") / LEAF)
    most_leaves = int(sources.agg(F.coalesce(F.max(leaves), F.lit(0))).first()[0])
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    s = sources.withColumnRenamed("source", "name")
    todo = rows.join(s, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id",
        "tag",
        "source",
        "size",
        "source_size",
        "target",
        F.pmod(F.xxhash64("doc_id", "tag", F.lit(SEED)), leaves).alias("leaf"),
        F.floor(times).alias("whole"),
        ((times - F.floor(times)) * F.col("size")).alias("mass"),
        F.lit(None).cast("long").alias("more"),
    )
    done, level = [], 0
    while True:
        final = most_leaves <= 1
        sorted_rows = todo.repartition("source", "leaf").sortWithinPartitions("source", "leaf", F.col("size").desc(), "doc_id", "tag")
        level_rows = keep(sorted_rows.mapInArrow(_settle(final, level), _ROUND), f"mix-level{level}")
        done.append(level_rows.filter("more is not null"))
        if final:
            break
        todo = level_rows.filter("more is null").withColumn("leaf", F.floor(F.col("leaf") / FAN))
        most_leaves, level = -(-most_leaves // FAN), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = F.col("whole") + F.col("more")
    return out.select("doc_id", "tag", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def taken(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs, with all their columns, each as many times as the mix takes it.

    The copies of rows with one doc_id, text and source are summed and dealt out to them in turn. A null or empty text has
    no words and is taken as often as its source's share says, rounded down; a null doc_id is an id, a null source a source
    like others; texts of any length count whole; equal rows are one document to which its copies are dealt; no rows give no rows; columns of docs may have any names.
    """
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    of, tag, source, total, rows, n, turn = (mark + x for x in ("of", "tag", "source", "total", "rows", "n", "turn"))
    copies = mixed(docs, share, most).groupBy(F.col("doc_id").alias(of), F.col("tag").alias(tag), F.col("source").alias(source)).agg(F.sum("copies").alias(total), F.count("*").alias(rows))
    copies = keep(copies.filter(F.col(total) > 0), "mix-copies")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(tag)) & F.col("source").eqNullSafe(F.col(source))
    both = docs.join(copies, same)
    single = both.filter(F.col(rows) == 1).withColumn(n, F.col(total))
    # rows that differ in other columns only: any order of them will do
    several = both.filter(F.col(rows) > 1).withColumn(turn, F.row_number().over(Window.partitionBy(of, tag, source).orderBy(tag)))
    several = several.withColumn(n, F.expr(f"{total} div {rows} + int({turn} <= {total} % {rows})")).drop(turn)
    every = single.unionByName(several).filter(F.col(n) > 0)
    return every.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)
