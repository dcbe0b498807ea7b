"""What the operators share: tables in the shared folder, and an identity for rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.storage import drop, new_path, put_file, ship, written  # noqa: F401


def with_row_id(docs: DataFrame, *columns: str) -> DataFrame:
    """row_id: a hash of doc_id and text, the same in every attempt of a task. Equal rows share it."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row_id"), "doc_id", "text", *columns)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
