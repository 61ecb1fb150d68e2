"""Files as DataFrames, and chunks and processed documents as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FileError
from ..functions import text as T
from .versions import Version, Versions, chunk_statistics


def decoded(content: Column) -> Column:
    """struct<text, error> of a file's bytes: text with line ends as \\n (a byte-order mark stays) if they are UTF-8, and why not if they aren't."""
    raw = content.cast("string")
    good = F.is_valid_utf8(raw)
    return F.struct(F.when(good, F.regexp_replace(raw, r"\r\n?", "\n")).alias("text"), F.when(~good, F.lit("the file is not UTF-8")).alias("error"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """md_path, md_content, image_dir, error_class, error_message of the .md and .markdown files under path; line ends as \\n, a byte-order mark stays.

    A file that isn't UTF-8 has no content but a FileError; bytes are checked on the JVM, and none is replaced by another. Files without a byte
    aren't read by Spark and so aren't here; they have no chunks either.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("md_path"), "content")
    files = files.filter(F.lower(T.suffix(F.col("md_path"))).isin(".md", ".markdown")).withColumn("read", decoded(F.col("content")))
    return files.select(
        "md_path",
        F.col("read.text").alias("md_content"),
        F.concat(T.parent(F.col("md_path")), F.lit("/images")).alias("image_dir"),
        F.when(F.col("read.error").isNotNull(), "FileError").alias("error_class"),
        F.col("read.error").alias("error_message"),
    )


_IMAGE = "image_dir string, image_name string, path string, length long, error_class string, error_message string"


def _listed(extensions: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(x.split()[0], pa.int64() if x.endswith(" long") else pa.string()) for x in _IMAGE.split(", ")])
        for batch in batches:
            for at in batch.column("image_dir").to_pylist():
                rows = []
                try:
                    store, path = FileSystem.from_uri(at)
                    kind = store.get_file_info(path).type
                    if kind == FileType.Directory:
                        # only files of the folder itself, in a fixed order
                        found = [x for x in store.get_file_info(FileSelector(path)) if x.type == FileType.File and x.base_name.casefold().endswith(tuple(extensions))]
                        rows = [(at, x.base_name, x.path, x.size, None, None) for x in sorted(found, key=lambda x: (x.base_name.casefold(), x.base_name))]
                    elif kind != FileType.NotFound:
                        rows = [(at, None, None, None, "ImageError", f"{at} is no folder")]
                except (OSError, pa.ArrowInvalid) as e:
                    rows = [(at, None, None, None, "ImageError", f"{at}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return run


def list_images(folders: DataFrame, extensions: frozenset[str]) -> DataFrame:
    """image_dir, image_name, path, length of the image files in each folder of folders (image_dir), ordered by name within it.

    Subfolders and contents are not read. A folder that isn't there has no images; one that is no folder or can't be
    read is a row with error_class and error_message.
    """
    return folders.filter("image_dir is not null").select("image_dir").distinct().mapInArrow(_listed(frozenset(x.casefold() for x in extensions)), _IMAGE)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path and data_url of image files under path; null for formats that models don't take."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", T.data_url(F.col("path"), F.col("content")).alias("data_url"))


def converted_path(pdf: Column, output_dir: Column) -> Column:
    """Where the command-line converter leaves the Markdown of a PDF."""
    s = T.stem(pdf)
    return F.concat_ws("/", output_dir, s, F.lit("auto"), F.concat(s, F.lit(".md")))


def write_chunks(chunks: DataFrame, path: str, keep: int = 3) -> Version:
    """Publish chunks as the next version of the table at path, with their statistics; readers see the version before until it is complete."""
    return Versions(chunks.sparkSession, path).publish(chunks, keep, statistics=chunk_statistics())


def write_chunk_json(chunks: DataFrame, path: str, keep: int = 3) -> Version:
    """The same as JSON lines, for people and other tools: a backup in versions, statistics beside them."""
    return Versions(chunks.sparkSession, path).publish(chunks, keep, "json", chunk_statistics())


def read_chunks(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunks that were published last, or an earlier version that is kept."""
    return Versions(spark, path).read(version)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        errors = []
        for at, text in zip(batch.column("to").to_pylist(), batch.column("md_content").to_pylist(), strict=True):
            try:
                store, path = FileSystem.from_uri(at)
                with store.open_output_stream(path) as out:
                    out.write(text.encode())
                errors.append(None)
            except (OSError, pa.ArrowInvalid) as e:
                errors.append(f"{at}: {e}")
        yield pa.RecordBatch.from_arrays([pa.array(errors, pa.string())], ["error"])


def write_markdown(docs: DataFrame) -> int:
    """Write processed documents (md_path, md_content), a file each, beside their sources by output_path; the number of files.

    Line ends are written as they are; a file of an earlier run is replaced, the source stays. Paths may be local or in any
    store with a URI. A null md_path or md_content, or a path that can't be written, is a FileError after all others are written.
    """
    rows = docs.select(T.output_path(F.col("md_path")).alias("to"), "md_content")
    missing = rows.filter("to is null or md_content is null").count()
    done = rows.filter("to is not null and md_content is not null").mapInArrow(_written, "error string")
    n, failed, first = done.agg(F.count("*"), F.count("error"), F.min("error")).first()
    if failed or missing:
        raise FileError(f"{failed + missing} documents not written: {first or 'a path or a text is missing'}", "images")
    return n
