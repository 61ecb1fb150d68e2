"""Errors. On a DataFrame of documents they become columns of the row that has them; only configuration errors stop a job."""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("inkstone")


class ImportFailure(Exception):
    """Root of all errors of an import: a message, the stage, and what caused it."""

    def __init__(self, message: str, stage: str = "", cause: BaseException | None = None):
        super().__init__(message)
        self.message, self.stage, self.cause = message, stage, cause

    def __str__(self) -> str:
        head = f"[{self.stage}] " if self.stage else ""
        return f"{head}{self.message}" + (f" (原因: {self.cause})" if self.cause else "")


class FieldError(ImportFailure):
    """A field is missing or unusable."""


class ConfigError(ImportFailure):
    """The configuration is invalid; raised on the driver before any job."""


class FileError(ImportFailure):
    """A file can't be read or written."""


class PdfError(FileError):
    """A PDF can't be converted."""


class ImageError(FileError):
    """An image can't be processed."""


class SplitError(ImportFailure):
    """A document can't be split."""


class StoreError(ImportFailure):
    """An object store fails."""


class ModelError(ImportFailure):
    """A model service fails."""


KINDS = {x.__name__: x for x in (FieldError, ConfigError, FileError, PdfError, ImageError, SplitError, StoreError, ModelError)}


def flagged(df: DataFrame, stage: str, *checks: tuple[Column, type[ImportFailure], str]) -> DataFrame:
    """df with error_class, error_message and stage of the first check that holds (null: none); earlier errors stay."""
    kind, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for bad, cls, text in reversed(checks):
        kind, message = F.when(bad, cls.__name__).otherwise(kind), F.when(bad, text).otherwise(message)
    new = kind.isNotNull()
    if "error_class" in df.columns:
        had = F.col("error_class").isNotNull()
        kind, message = F.coalesce("error_class", kind), F.when(had, F.col("error_message")).otherwise(message)
        name = F.when(had, F.col("stage")).otherwise(F.when(new, stage))
    else:
        name = F.when(new, stage)
    return df.withColumns({"error_class": kind, "error_message": message, "stage": name})


def strict(df: DataFrame) -> DataFrame:
    """df without its error columns; a row with an error fails the job."""
    stop = F.raise_error(F.concat_ws(": ", "stage", "error_class", "error_message"))
    checked = df.filter(F.when(F.col("error_class").isNotNull(), stop.cast("boolean")).otherwise(True))
    return checked.drop("error_class", "error_message", "stage")


def stage(name: str) -> Callable:
    """A decorator for functions of a DataFrame: its jobs carry the stage's name, and unclassified errors become failures of the stage."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(df: DataFrame, *args, **kwargs):
            log.info("%s: begins", name)
            df.sparkSession.sparkContext.setJobDescription(name)
            try:
                out = f(df, *args, **kwargs)
            except ImportFailure:
                raise
            except Exception as e:
                raise ImportFailure(str(e), name, e) from e
            log.info("%s: planned", name)
            return out

        return run

    return wrap


@contextmanager
def enveloped(stage: str, every: bool, *passed: type[ImportFailure]) -> Iterator[dict[str, str]]:
    """Inside a task: what fails in the block is put into the dict (error_class, error_message, stage) and the next row goes on.

    Errors of the given classes always are; any other one if every is true, an unclassified one as a failure of the stage.
    """
    found: dict[str, str] = {}
    try:
        yield found
    except Exception as e:
        if not every and not isinstance(e, passed):
            raise
        classified = isinstance(e, ImportFailure)
        found |= {"error_class": type(e).__name__ if classified else "ImportFailure", "error_message": e.message if classified else f"{type(e).__name__}: {e}", "stage": stage}


@contextmanager
def running(stage: str, df: DataFrame) -> Iterator[None]:
    """Around an action: its jobs carry the stage's name, and a job that fails raises an ImportFailure of the stage, with what Spark says as its cause."""
    context = df.sparkSession.sparkContext
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(stage)
    log.info("%s: runs", stage)
    try:
        yield
    except ImportFailure:
        raise
    except (PySparkException, Py4JError) as e:
        lines = [x.strip() for x in str(e).splitlines() if x.strip()]
        raise ImportFailure(next((x for x in reversed(lines) if "Error" in x.split(":")[0] and not x.startswith("at ")), lines[0] if lines else type(e).__name__)[:500], stage, e) from e
    finally:
        context.setLocalProperty("spark.job.description", before)
    log.info("%s: done", stage)
