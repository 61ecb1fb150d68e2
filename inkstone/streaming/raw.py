"""Markdown files that arrive and change in a folder, as a stream whose table of chunks has the last version of each.

    files = changed_files(spark, folder)              # path, modified_at, content of new and changed files
    replaced(files, out, checkpoint).awaitTermination()
    current(spark, out)                               # chunks of the last version of each file

The source lists the folder at every trigger and takes what was changed since the last one; its offset is a time, so nothing about files
is kept on the driver. By path, the stream's state has the digest of the last content: a file that was touched but not changed gives
nothing. Each batch adds a folder of chunks with its number, which a batch that is repeated writes again; a file's chunks from
earlier batches stay in the table, and readers take the last batch of each path. compacted() writes what readers see as a version.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..config import SplitConfig
from ..functions import text as T
from ..plans.documents import CHUNK, split
from ..sources.files import decoded
from ..sources.versions import Version, Versions, chunk_statistics

FILES = "path string, modified_at long, content binary"
#: Files that a task reads, at most.
FILES_IN_TASK = 100


class Files(InputPartition):
    """Files to be read by one task: path and time of change."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class ChangedFilesReader(DataSourceStreamReader):
    """Offsets are times (in nanoseconds): between two of them lie the files that were last changed then."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.suffixes = tuple(options.get("suffixes", ".md,.markdown").lower().split(","))
        #: Files changed in the last so many seconds wait for the next trigger, as another may still be written with the same time.
        self.grace = float(options.get("grace", "2"))

    def _listed(self) -> Iterator[FileInfo]:
        store, path = FileSystem.from_uri(self.folder)
        found = store.get_file_info(FileSelector(path, recursive=True, allow_not_found=True))
        return (x for x in found if x.type == FileType.File and x.path.lower().endswith(self.suffixes))

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.grace * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = sorted((x.path, x.mtime_ns) for x in self._listed() if start["until"] < x.mtime_ns <= end["until"])
        return [Files(files[i : i + FILES_IN_TASK]) for i in range(0, len(files), FILES_IN_TASK)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = FileSystem.from_uri(self.folder)
        for path, changed in partition.files:
            try:
                with store.open_input_stream(path) as data:
                    yield path, changed, data.read()
            except FileNotFoundError:  # gone since it was listed
                continue


class ChangedFiles(DataSource):
    """The streaming source inkstone_files: option path, and if wanted suffixes and grace."""

    @classmethod
    def name(cls) -> str:
        return "inkstone_files"

    def schema(self) -> str:
        return FILES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChangedFilesReader(self.options)


def changed_files(spark: SparkSession, folder: str, grace: float = 2.0) -> DataFrame:
    """A stream of the Markdown files under folder (a path or URI that all workers see): each when it comes and whenever it changes."""
    spark.dataSource.register(ChangedFiles)
    return spark.readStream.format("inkstone_files").option("path", folder).option("grace", str(grace)).load()


_STATE = "modified_at long, digest string"


def _last(key: tuple, tables: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of a path's rows the last, if its content isn't that of the state."""
    was = state.get if state.exists else (-1, None)
    last, changed, digest = None, was[0], was[1]
    for table in tables:
        newest = table.loc[table["modified_at"].idxmax()]
        if newest["modified_at"] >= changed:
            last, changed, digest = newest, int(newest["modified_at"]), newest["digest"]
    if last is not None:
        state.update((changed, digest))
        if digest != was[1]:
            yield pd.DataFrame([last])[["path", "modified_at", "digest", "content"]]


def last_versions(files: DataFrame) -> DataFrame:
    """path, modified_at, digest, content: of a stream of files (path, modified_at, content) those whose content is new for their path, the last of each."""
    return files.withColumn("digest", F.sha2("content", 256)).groupBy("path").applyInPandasWithState(_last, "path string, modified_at long, digest string, content binary", _STATE, "append", GroupStateTimeout.NoTimeout)


_WRITTEN = f"{CHUNK}, path string, modified_at long, digest string, error_class string, error_message string"


def _chunked(files: DataFrame, config: SplitConfig | None) -> DataFrame:
    """The chunks of files, with path and digest; a file without chunks is a row without a chunk, one that can't be read or split has an error in it."""
    read = files.withColumns({"doc_id": F.xxhash64("path"), "read": decoded(F.col("content"))}).drop("content")
    docs = read.select("doc_id", F.col("read.text").alias("md_content"), T.stem(F.col("path")).alias("file_title"), F.col("path").alias("md_path"))
    found = split(docs, config, errors=True).withColumnRenamed("doc_id", "of")
    own = read.select("doc_id", "path", "modified_at", "digest", F.when(F.col("read.error").isNotNull(), "FileError").alias("bad"), F.col("read.error").alias("why"))
    joined = own.join(found, own.doc_id == found.of, "left").drop("of")
    return joined.withColumns({"error_class": F.coalesce("bad", "error_class"), "error_message": F.coalesce("why", "error_message")}).select(*(x.split()[0] for x in _WRITTEN.split(", ")))


def replaced(files: DataFrame, out: str, checkpoint: str, config: SplitConfig | None = None, **trigger) -> StreamingQuery:
    """Keep the chunks of a stream of files (path, modified_at, content) at out, each file's by its last version."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # state was advanced for it once
        _chunked(batch, config).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    query = last_versions(files).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def _seen(spark: SparkSession, out: str) -> DataFrame:
    every = spark.read.schema(f"{_WRITTEN}, batch long").option("basePath", out).parquet(out)
    return every.withColumn("last", F.max("batch").over(Window.partitionBy("path"))).filter("batch = last").drop("last", "batch")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of the last version of each file, with its path and digest."""
    return _seen(spark, out).filter("chunk_index is not null").drop("error_class", "error_message")


def rejected(spark: SparkSession, out: str) -> DataFrame:
    """path, digest, error_class, error_message of the files whose last version has no chunks because of an error."""
    return _seen(spark, out).filter("error_class is not null").select("path", "digest", "error_class", "error_message")


def compacted(spark: SparkSession, out: str, to: str, keep: int = 3) -> Version:
    """Publish what readers see as a version of the table at to."""
    return Versions(spark, to).publish(current(spark, out), keep, statistics=chunk_statistics())

