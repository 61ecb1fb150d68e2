"""Image references in Markdown: found, joined with files, put in context and rewritten."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T
from ..functions.names import unused
from ..plans import context

# Formats of the input.
IMAGE = r"!\[([^\]\n]*)\]\(\s*([^)\n]+?)\s*\)"
BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def splitlines(text: Column) -> Column:
    """Lines at every kind of line end, without an empty one after the last."""
    parts = F.split(text, BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def destination(raw: Column) -> Column:
    """The target of a reference without its title or angle brackets; null if there is none."""
    s = T.strip(raw)
    angle = F.regexp_extract(s, r"\A<([^>]*)>", 1)
    plain = F.regexp_extract(s, r"(?U)\A(\S+)", 1)
    return F.when(s == "", None).when(s.startswith("<"), F.when(s.rlike(r"\A<[^>]*>"), angle)).otherwise(plain)


def scheme(target: Column) -> Column:
    return F.lower(F.regexp_extract(target, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1))


_GROUP, _OCTET = "[0-9A-Fa-f]{1,4}", "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def bad_authority(target: Column) -> Column:
    """Whether a target's authority can't be one: brackets that don't enclose an address, or stand elsewhere than around the host. False for null."""
    authority = F.regexp_extract(target, r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    host = F.regexp_extract(authority, r"(?s)([^@]*)\z", 1)
    inner = F.regexp_extract(host, r"(?s)\A\[([^\]]*)\](?::.*)?\z", 1)
    future = inner.rlike(r"(?s)\Av[0-9A-Fa-f]+\..+\z")
    # an address of 8 groups, or of fewer with one gap; its last two groups may be written as four numbers
    plain = F.regexp_replace(F.regexp_replace(inner, r"(?s)%.+\z", ""), rf"(?<=:)(?:{_OCTET}\.){{3}}{_OCTET}\z", "0:0")
    whole = plain.rlike(rf"\A{_GROUP}(?::{_GROUP}){{7}}\z")
    gap = plain.rlike(rf"\A(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?\z") & (F.regexp_count(plain, F.lit(_GROUP)) <= 7)
    return F.coalesce(authority.rlike(r"[\[\]]") & ~(future | whole | gap), F.lit(False))


def is_local(target: Column) -> Column:
    return F.coalesce(~scheme(target).isin("http", "https", "data"), F.lit(False))


def unquoted(c: Column) -> Column:
    """c with percent escapes of UTF-8 decoded; unchanged if one isn't valid. A plus stays a plus."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def basename(target: Column) -> Column:
    """The file name that a target points at, lower-cased as files are matched."""
    path = F.regexp_extract(target, r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.lower(T.name(F.replace(unquoted(path), F.lit("\\"), F.lit("/"))))


def references(docs: DataFrame) -> DataFrame:
    """doc_id, ref_no, alt, raw_destination, destination, is_local, image_key of every reference in docs (doc_id, md_content)."""
    both = F.arrays_zip(F.regexp_extract_all("md_content", F.lit(IMAGE), F.lit(1)).alias("alt"), F.regexp_extract_all("md_content", F.lit(IMAGE), F.lit(2)).alias("raw"))
    s = docs.select("doc_id", F.posexplode(both).alias("ref_no", "r"))
    target = destination(F.col("r.raw"))
    s = s.select("doc_id", "ref_no", F.col("r.alt").alias("alt"), F.col("r.raw").alias("raw_destination"), target.alias("destination"))
    local = is_local(F.col("destination"))
    return s.withColumns({"is_local": local, "image_key": F.when(local, F.nullif(basename(F.col("destination")), F.lit("")))})


def _named(files: DataFrame, refs: DataFrame, how: str) -> DataFrame:
    key, of = unused("key", files), unused("of", files)
    names = refs.filter("is_local").select(F.col("doc_id").alias(of), F.col("image_key").alias(key)).distinct()
    return files.join(names, (files.doc_id == F.col(of)) & (F.lower(files.image_name) == F.col(key)), how)


def referenced(files: DataFrame, refs: DataFrame) -> DataFrame:
    """The files (doc_id, image_name, ...) that a local reference of their document names; none of a null doc_id or name."""
    return _named(files, refs, "left_semi")


def unreferenced(files: DataFrame, refs: DataFrame) -> DataFrame:
    """The other files."""
    return _named(files, refs, "left_anti")


def _with_first(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, md_content, the carried columns, first: array<struct<image_key, line_no>> of the first line with a local reference to each image, by image_key."""

    def on_line(line: Column, at: Column) -> Column:
        to = F.transform(F.regexp_extract_all(line, F.lit(IMAGE), F.lit(2)), destination)
        return F.transform(F.filter(to, is_local), lambda x: F.struct(basename(x).alias("image_key"), at.cast("int").alias("line_no")))

    every = F.array_sort(F.flatten(F.transform(splitlines(F.col("md_content")), on_line)))
    s = docs.select("doc_id", "md_content", *carried, every.alias("every"))
    before = F.concat(F.array(F.lit(None).cast("struct<image_key:string,line_no:int>")), F.slice("every", F.lit(1), F.greatest(F.size("every") - 1, F.lit(0))))
    new = F.zip_with("every", before, lambda x, y: F.when(y.isNull() | ~x["image_key"].eqNullSafe(y["image_key"]), x))
    return s.select("doc_id", "md_content", *carried, F.filter(new, lambda x: x.isNotNull()).alias("first"))


def first_references(docs: DataFrame) -> DataFrame:
    """doc_id, image_key, line_no of the first line with a local reference to each image, for each row of docs (doc_id, md_content)."""
    return _with_first(docs).select("doc_id", F.inline("first"))


_FIELDS = ("image_key", "line_no", "heading", "pre_text", "post_text")
_CONTEXT = K.StructType([K.StructField(x, K.IntegerType() if x == "line_no" else K.StringType()) for x in _FIELDS])
_CONTEXT_TYPE = pa.struct([(x, pa.int32() if x == "line_no" else pa.string()) for x in _FIELDS])


@F.arrow_udf(K.ArrayType(_CONTEXT))
def _contexts(text: pa.Array, first: pa.Array, limit: pa.Array) -> pa.Array:
    out = []
    for t, places, n in zip(text.to_pylist(), first.to_pylist(), limit.to_pylist(), strict=True):
        around = context.contexts(t, [x["line_no"] for x in places], n) if t is not None and places else []
        out.append([{**x, "heading": head, "pre_text": before, "post_text": after} for x, (head, before, after) in zip(places or (), around, strict=False)])
    return pa.array(out, pa.list_(_CONTEXT_TYPE))


def contexts(docs: DataFrame, limit: int, *carried: str) -> DataFrame:
    """doc_id, the carried columns, image_key, line_no, heading, pre_text, post_text for the first reference to each image of each row of docs (doc_id, md_content).

    Context is whole paragraphs between the nearest headings, nearest first while limit characters hold them (the
    first one always); blank lines and lines with images end a paragraph. A document stays in its row: nothing is
    exchanged, and rows with one doc_id are read each by itself. A null text has no images.
    """
    # no filter on what is found: it would be pushed below, and find everything again for itself
    return _with_first(docs, *carried).select("doc_id", *carried, F.inline(_contexts("md_content", "first", F.lit(limit))))


def rewritten(docs: DataFrame, images: DataFrame) -> DataFrame:
    """docs with md_content whose local references to stored images have the image's summary and url.

    images: doc_id, image_name, summary, url. References to other images, to remote ones and to images whose url
    isn't HTTP(S) stay as they are. Of files whose names differ in case only, the last in order of image_name (then url) counts.
    """
    known, of = unused("known", docs), unused("of", docs)
    stored = images.groupBy("doc_id", F.lower("image_name").alias("image_key")).agg(F.max(F.struct("image_name", "url", "summary")).alias("x"))
    stored = stored.filter(F.col("x.url").rlike("(?i)^https?:"))
    by_doc = stored.groupBy(F.col("doc_id").alias(of)).agg(F.map_from_entries(F.collect_list(F.struct("image_key", "x"))).alias(known))  # the images of one document
    matches = F.regexp_extract_all("md_content", F.lit(IMAGE), F.lit(0))
    gaps = F.split("md_content", IMAGE, -1)
    parts = F.arrays_zip(matches.alias("whole"), F.regexp_extract_all("md_content", F.lit(IMAGE), F.lit(1)).alias("alt"), F.regexp_extract_all("md_content", F.lit(IMAGE), F.lit(2)).alias("raw"))

    def one(r: Column) -> Column:
        to = destination(r["raw"])
        found = F.when(is_local(to), F.try_element_at(known, basename(to)))
        alt = T.alt_text(F.coalesce(F.nullif(found["summary"], F.lit("")), r["alt"]))
        return F.coalesce(F.concat(F.lit("!["), F.when(found.isNotNull(), alt), F.lit("]("), found["url"], F.lit(")")), r["whole"])

    new = F.concat(gaps[0], F.array_join(F.zip_with(F.transform(parts, one), F.slice(gaps, F.lit(2), F.size(gaps)), lambda a, b: F.concat(a, b)), ""))
    joined = docs.join(by_doc, docs.doc_id == F.col(of), "left")
    return joined.withColumn("md_content", F.when(F.col(known).isNull(), F.col("md_content")).otherwise(new)).drop(known, of)


def upload_stats(images: DataFrame) -> DataFrame:
    """doc_id, n_images, n_uploaded, n_fallback."""
    remote = F.coalesce(F.col("url").rlike("(?i)^https?:"), F.lit(False))
    return images.groupBy("doc_id").agg(F.count("*").alias("n_images"), F.count_if(remote).alias("n_uploaded"), F.count_if(~remote).alias("n_fallback"))
