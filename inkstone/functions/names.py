"""Names of columns that operators need for themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(stem: str, *tables: DataFrame) -> str:
    """stem, or stem with underscores, as no column of the tables is named."""
    taken = {c.lower() for t in tables for c in t.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
