"""Which files and documents are taken, and by which route: filters and projections without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FieldError, PdfError, flagged
from ..functions import text as T
from ..functions.names import unused


def _kind(path: Column) -> Column:
    s = F.lower(T.suffix(T.strip(path)))
    return F.when(s == ".pdf", "pdf").when(s.isin(".md", ".markdown"), "markdown")


def classified(files: DataFrame) -> DataFrame:
    """files (import_file_path) with is_pdf_read_enabled, is_md_read_enabled, pdf_path and md_path, or an error."""
    kind, path = _kind(F.col("import_file_path")), T.strip(F.col("import_file_path"))
    out = files.withColumns(
        {
            "is_pdf_read_enabled": F.coalesce(kind == "pdf", F.lit(False)),
            "is_md_read_enabled": F.coalesce(kind == "markdown", F.lit(False)),
            "pdf_path": F.when(kind == "pdf", path),
            "md_path": F.when(kind == "markdown", path),
        }
    )
    return flagged(out, "entry", (T.blank(F.col("import_file_path")), FieldError, "import_file_path is missing"), (kind.isNull(), FieldError, "the file type is not supported"))


def route(pdf: Column, markdown: Column) -> Column:
    """'pdf' or 'markdown' if exactly that flag is true, else null."""
    p, m = pdf.eqNullSafe(F.lit(True)), markdown.eqNullSafe(F.lit(True))
    return F.when(p & ~m, "pdf").when(m & ~p, "markdown")


def routed(files: DataFrame) -> DataFrame:
    """files with route, or an error where the flags are not exclusive."""
    out = files.withColumn("route", route(F.col("is_pdf_read_enabled"), F.col("is_md_read_enabled")))
    return flagged(out, "entry", (F.col("route").isNull(), FieldError, "exactly one route must be enabled"))


def branched(files: DataFrame, convert) -> DataFrame:
    """PDF rows through convert (DataFrame -> DataFrame of the same columns), Markdown rows as they are, together again."""
    return convert(files.filter("route = 'pdf'")).unionByName(files.filter("route = 'markdown'"))


def valid_pdf(path: Column) -> Column:
    return F.coalesce(F.lower(T.suffix(path)) == ".pdf", F.lit(False))


def checked_pdfs(files: DataFrame, listing: DataFrame) -> DataFrame:
    """files (pdf_path) with output_dir, or an error where the path is no PDF or not in listing (path)."""
    there = unused("there", files)
    listed = listing.select(F.col("path").alias(there)).distinct()
    out = files.join(listed, F.col("pdf_path") == F.col(there), "left").withColumn("output_dir", T.parent(F.col("pdf_path")))
    bad = ~valid_pdf(F.col("pdf_path")) | F.col(there).isNull()
    return flagged(out, "pdf", (bad, PdfError, "the PDF does not exist or is none")).drop(there)


def valid_markdown_path(path: Column) -> Column:
    return F.coalesce(F.lower(T.suffix(T.strip(path))).isin(".md", ".markdown"), F.lit(False))


def title(file_title: Column, import_path: Column, md_path: Column) -> Column:
    """The given title, else the stem of the imported file, else that of the Markdown file; null if all are blank."""
    stem = lambda c: T.filled(T.stem(T.strip(c)))
    return F.coalesce(T.filled(file_title), stem(import_path), stem(md_path))


def directory(file_dir: Column, md_path: Column) -> Column:
    return F.coalesce(T.filled(file_dir), T.parent(T.strip(md_path)))


def checked_documents(docs: DataFrame) -> DataFrame:
    """docs (md_content, md_path, import_file_path, file_title, file_dir) normalised, or with an error. An empty md_content is fine."""
    found = title(F.col("file_title"), F.col("import_file_path"), F.col("md_path"))
    name = unused("found_title", docs)
    out = flagged(
        docs.withColumn(name, found),
        "split",
        (F.col("md_content").isNull(), FieldError, "md_content is missing"),
        (~valid_markdown_path(F.col("md_path")), FieldError, "md_path is no Markdown file"),
        (F.col(name).isNull(), FieldError, "no title can be found"),
    )
    return out.withColumns({"md_content": T.normalized(F.col("md_content")), "file_title": F.col(name), "file_dir": directory(F.col("file_dir"), F.col("md_path"))}).drop(name)
