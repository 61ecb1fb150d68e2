"""From documents to chunks: the whole import as DataFrame stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ImageConfig, SplitConfig
from ..errors import ImportFailure, SplitError, enveloped, flagged, stage
from ..functions import text as T
from ..functions.names import unused
from ..operators import images as I
from ..operators.validate import checked_documents, classified, routed
from . import splitter

CHUNK = (
    "doc_id long, chunk_index int, file_title string, title string, parent_title string, heading_path array<string>, source_titles array<string>, "
    "source_section_indexes array<int>, body string, content string, char_count int, source_path string"
)
_CHUNK = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("chunk_index", pa.int32()),
        ("file_title", pa.string()),
        ("title", pa.string()),
        ("parent_title", pa.string()),
        ("heading_path", pa.list_(pa.string())),
        ("source_titles", pa.list_(pa.string())),
        ("source_section_indexes", pa.list_(pa.int32())),
        ("body", pa.string()),
        ("content", pa.string()),
        ("char_count", pa.int32()),
        ("source_path", pa.string()),
    ]
)
_ERROR = "error_class string, error_message string"
#: Documents whose chunks are sent back to the JVM together, and the characters in them (with their titles) after which more go by themselves.
_BATCH, _CHARACTERS = 64, 4_000_000


@stage("split")
def split(docs: DataFrame, config: SplitConfig | None = None, errors: bool = False) -> DataFrame:
    """The chunks of docs (doc_id, md_content, file_title, md_path), without any shuffle.

    A null md_content has no chunks. A document that can't be split (a title that leaves no room for text unless config keeps it, or any other failure) has none
    either; with errors it is a row with error_class and error_message instead (other rows: null), without them only the first kind is passed over.
    """
    config = config or SplitConfig()
    schema = _CHUNK if not errors else pa.schema([*_CHUNK, pa.field("error_class", pa.string()), pa.field("error_message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                out, held = [], 0
                for doc in batch.slice(at, _BATCH).to_pylist():
                    with enveloped("split", errors, SplitError) as failure:
                        for c in splitter.each_chunk(doc["md_content"], doc["file_title"] or "", doc["md_path"], config) if doc["md_content"] is not None else ():
                            out.append({"doc_id": doc["doc_id"], **c})
                            held += c["char_count"] + len(c["body"]) + 2 * sum(map(len, c["source_titles"])) + len(c["parent_title"])
                            if held > _CHARACTERS:
                                yield pa.RecordBatch.from_pylist(out, schema=schema)
                                out, held = [], 0
                    if failure and errors:
                        out.append({"doc_id": doc["doc_id"], "error_class": failure["error_class"], "error_message": failure["error_message"]})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "md_content", "file_title", "md_path")
    return rows.mapInArrow(run, f"{CHUNK}, {_ERROR}" if errors else CHUNK)


@stage("images")
def with_images(docs: DataFrame, files: DataFrame, describe: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], DataFrame], written: Callable[[DataFrame], DataFrame], config: ImageConfig) -> DataFrame:
    """docs with the references to their images (files: doc_id, image_name, path, data_url) described and pointing at the store.

    describe adds summary, store adds url; written makes a table of what the services said, so they are asked once.
    """
    config = config.checked()
    found = I.referenced(files, I.references(docs))
    names = [unused(x, found) for x in ("of", "key", "head", "before", "after")]
    context = I.contexts(docs, config.context, "file_title").dropDuplicates(["doc_id", "image_key"])  # rows with one doc_id ask once for an image
    context = context.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "image_key", "heading", "pre_text", "post_text"), names, strict=True)), "file_title")
    asked = found.join(context, (F.col("doc_id") == F.col(names[0])) & (F.lower("image_name") == F.col(names[1])))
    asked = asked.withColumn("prompt", T.prompt(F.col("file_title"), *map(F.col, names[2:]))).drop(*names)
    described = written(describe(asked)).withColumn("summary", T.summary(F.col("summary")))
    key = object_key(F.col("file_title"), F.col("image_name"))
    kind = F.coalesce(T.media_type(F.col("image_name")), F.when(F.lower(T.suffix(F.col("image_name"))) == ".bmp", "image/bmp"), F.lit("application/octet-stream"))
    named = described.withColumns({"object_key": key, "content_type": kind, "object_url": T.object_url(F.lit(config.base_url().rstrip("/")), F.lit(config.bucket.strip()), key)})
    return I.rewritten(docs, written(store(named)))


def object_key(document: Column, image: Column) -> Column:
    return F.concat_ws("/", F.lit("knowledge"), T.safe_directory(document), image)


def imported(docs: DataFrame, config: SplitConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected): documents checked and split; those that fail with error_class, error_message and stage."""
    checked = checked_documents(docs)
    good = checked.filter("error_class is null").drop("error_class", "error_message", "stage")
    parts = split(good, config, errors=True)
    failed = parts.filter("error_class is not null").select("doc_id", "error_class", "error_message", F.lit("split").alias("stage"))
    rejected = checked.filter("error_class is not null").select("doc_id", "error_class", "error_message", "stage").unionByName(failed)
    return parts.filter("error_class is null").drop("error_class", "error_message"), rejected


def imported_files(
    files: DataFrame,
    contents: DataFrame,
    convert: Callable[[DataFrame], DataFrame],
    images: Callable[[DataFrame], DataFrame] = lambda docs: docs,
    config: SplitConfig | None = None,
    image_files: DataFrame | None = None,
    written: Callable[[DataFrame], DataFrame] = lambda table: table,
) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected) of files (doc_id, import_file_path): the whole import, from paths to chunks.

    Paths are classified and take one of two routes. convert makes doc_id, md_content, error_class, error_message of the
    PDFs (doc_id, pdf_path, ...); Markdown files find their text in contents (md_path, md_content, and error_class and error_message if
    reading can fail). Both meet again, images works on all of them, and they are checked and split. What fails on the way is rejected with
    its stage, and the rest goes on: every file has chunks, or is rejected, or has an empty text.

    convert and images feed several branches, so written (a table, a checkpoint) should keep what it is given; without it they are asked
    for each branch again unless they keep a ledger. image_files (doc_id, ...): the image files beside documents, whose references are then checked.
    """
    entry = classified(files)
    ready = routed(entry.filter("error_class is null").drop("error_class", "error_message", "stage"))
    pdfs, texts = ready.filter("route = 'pdf'"), ready.filter("route = 'markdown'")
    made = written(convert(pdfs).select(F.col("doc_id").alias("of"), "md_content", "error_class", "error_message"))
    left_at = F.concat_ws("/", T.parent(F.col("pdf_path")), T.stem(F.col("pdf_path")), F.lit("auto"), F.concat(T.stem(F.col("pdf_path")), F.lit(".md")))
    converted = pdfs.select("doc_id", "import_file_path", left_at.alias("md_path")).join(made, F.col("doc_id") == F.col("of"), "left")
    silent = F.col("error_class").isNull() & F.col("md_content").isNull()
    converted = converted.select("doc_id", "import_file_path", "md_path", "md_content", F.when(silent, "PdfError").otherwise(F.col("error_class")).alias("error_class"), F.when(silent, "the converter gave no text").otherwise(F.col("error_message")).alias("error_message"))
    had = [F.col(c) if c in contents.columns else F.lit(None).cast("string").alias(c) for c in ("error_class", "error_message")]
    known = contents.select(F.col("md_path").alias("found"), "md_content", *had)
    read = texts.select("doc_id", "import_file_path", "md_path").join(known, F.col("md_path") == F.col("found"), "left")
    gone = F.col("error_class").isNull() & F.col("md_content").isNull()
    read = read.select("doc_id", "import_file_path", "md_path", "md_content", F.when(gone, "FileError").otherwise(F.col("error_class")).alias("error_class"), F.when(gone, "the file can't be read").otherwise(F.col("error_message")).alias("error_message"))
    both = converted.withColumn("stage", F.lit("pdf")).unionByName(read.withColumn("stage", F.lit("images")))
    good = both.filter("error_class is null").drop("error_class", "error_message", "stage").withColumns({c: F.lit(None).cast("string") for c in ("file_title", "file_dir")})
    checked = checked_documents(good)
    if image_files is not None:
        checked = checked_references(checked, image_files)
    passed = checked.filter("error_class is null").drop("error_class", "error_message", "stage")
    parts = written(split(images(passed), config, errors=True))
    failed = ["doc_id", "error_class", "error_message", "stage"]
    rejected = parts.filter("error_class is not null").select(*failed[:3], F.lit("split").alias("stage"))
    for table in (entry, both, checked):
        rejected = rejected.unionByName(table.filter("error_class is not null").select(*failed))
    return parts.filter("error_class is null").drop("error_class", "error_message"), rejected


def checked_references(docs: DataFrame, image_files: DataFrame) -> DataFrame:
    """docs (doc_id, md_content, ...) with an error for those beside which there are image files and in which a reference has an authority that is none."""
    mark, of = unused("beside", docs), unused("of", docs)
    beside = image_files.select(F.col("doc_id").alias(of)).filter(F.col(of).isNotNull()).distinct().withColumn(mark, F.lit(True))
    bad = F.exists(F.regexp_extract_all("md_content", F.lit(I.IMAGE), F.lit(2)), lambda raw: I.bad_authority(I.destination(raw)))
    joined = docs.join(beside, docs.doc_id == F.col(of), "left")
    return flagged(joined, "images", (F.col(mark) & bad, ImportFailure, "an image reference has no valid authority")).drop(mark, of)
