"""Continuous import: documents that arrive in a folder become chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import SplitConfig
from ..plans.documents import split

DOCUMENTS = "doc_id long, md_content string, file_title string, md_path string"


def arriving(spark: SparkSession, path: str, schema: str = DOCUMENTS) -> DataFrame:
    """Documents of the Parquet files that arrive under path."""
    return spark.readStream.schema(schema).parquet(path)


def chunk_stream(docs: DataFrame, out: str, checkpoint: str, config: SplitConfig | None = None, **trigger) -> StreamingQuery:
    """Chunks of a stream of documents, appended to the table at out. Splitting needs no state, so it runs in the stream itself."""
    writer = split(docs, config).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
