"""Chunk sizing over a document's arrays: gates and paths as Column expressions, packing, overlap and merging (ordered folds) as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T
from ..plans import splitter
from .lines import rendered

SENTENCE = r"[^。！？；.!?;]+[。！？；.!?;]?"


def length_gate(parts: DataFrame, max_length: int) -> DataFrame:
    """parts (title, body) with content_length, is_long, and for long ones body_budget (0 or less: the title leaves no room)."""
    content = rendered(F.col("title"), F.col("body"))
    size = F.length(content)
    budget = F.lit(max_length) - F.length(T.strip(F.col("title"))) - F.when(T.blank(F.col("body")), 0).otherwise(2)
    return parts.withColumns({"content_length": size, "is_long": size > max_length, "body_budget": F.when(size > max_length, budget)})


def sentences(text: Column) -> Column:
    """The sentences of a text, stripped, blank ones left out."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), T.strip), lambda s: s != "")


def recursive_splitter(spaces: str | None = None) -> Callable[..., Column]:
    """A function of text and size: pieces of at most size characters, cut at the coarsest separator that occurs. At their ends go these characters, or all white space."""

    @F.arrow_udf(K.ArrayType(K.StringType()))
    def recursive_split(text: pa.Array, size: pa.Array) -> pa.Array:
        pairs = zip(text.to_pylist(), size.to_pylist(), strict=True)
        return pa.array([None if t is None else splitter.recursive_split(t, n, spaces=spaces) for t, n in pairs], pa.list_(pa.string()))

    return recursive_split


recursive_split = recursive_splitter()


@F.arrow_udf(K.ArrayType(K.StringType()))
def pack_pieces(pieces: pa.Array, budget: pa.Array) -> pa.Array:
    """Neighbouring pieces (struct<text, atomic>) joined by blank lines up to budget; an atomic piece over it stands alone."""
    pairs = zip(pieces.to_pylist(), budget.to_pylist(), strict=True)
    return pa.array([None if xs is None else splitter.packed([(x["text"], x["atomic"]) for x in xs], n) for xs, n in pairs], pa.list_(pa.string()))


@F.arrow_udf(K.ArrayType(K.StringType()))
def _overlapped(parts: pa.Array, budget: pa.Array, overlap: pa.Array) -> pa.Array:
    rows = zip(parts.to_pylist(), budget.to_pylist(), overlap.to_pylist(), strict=True)
    return pa.array([None if xs is None else splitter.overlapped(xs, n, k) for xs, n, k in rows], pa.list_(pa.string()))


def sentence_overlap(parts: Column, budget: Column, overlap: int) -> Column:
    """Each part behind as many of the last sentences of the part before, as it stands by then, as fit."""
    return _overlapped(parts, budget, F.lit(overlap))


_GROUP = K.StructType([K.StructField(x, K.IntegerType()) for x in ("first", "last", "length")])


@F.arrow_udf(K.ArrayType(_GROUP))
def _neighbours(drafts: pa.Array, least: pa.Array, most: pa.Array) -> pa.Array:
    names = ("first", "last", "length")
    rows = zip(drafts.to_pylist(), least.to_pylist(), most.to_pylist(), strict=True)
    found = [None if xs is None else [dict(zip(names, g, strict=True)) for g in splitter.neighbours(((x["key"], x["length"]) for x in xs), low, high)] for xs, low, high in rows]
    return pa.array(found, pa.list_(pa.struct([(x, pa.int32()) for x in names])))


def merge_short(drafts: Column, min_length: int, max_length: int) -> Column:
    """Groups array<struct<first,last,length>> of drafts array<struct<key,length>>.

    A short group takes in those after it while they have its key and fit; one that stays short joins the group
    before it if it may. Only keys and lengths are carried: the length of joined drafts is a + 2 + b.
    """
    return _neighbours(drafts, F.lit(min_length), F.lit(max_length))


def common_path(paths: Column) -> Column:
    """The longest beginning that all of an array of heading paths share."""
    first = F.get(paths, F.lit(0))
    shared = lambda i: F.forall(paths, lambda p: F.get(p, i).eqNullSafe(F.get(first, i)))
    differ = F.filter(F.sequence(F.lit(0), F.size(first)), lambda i: (i == F.size(first)) | ~shared(i))
    return F.slice(first, F.lit(1), F.array_min(differ))


def stats(chunks: DataFrame) -> DataFrame:
    """doc_id, n_chunks, n_chars, n_sections, min_chars, max_chars of chunks."""
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"),
        F.sum("char_count").cast("long").alias("n_chars"),
        F.size(F.array_distinct(F.flatten(F.collect_list("source_section_indexes")))).cast("long").alias("n_sections"),
        F.min("char_count").cast("long").alias("min_chars"),
        F.max("char_count").cast("long").alias("max_chars"),
    )
