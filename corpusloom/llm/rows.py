"""Rows with stable numbers, so that later stages shuffle a number and not a text."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textops
from corpusloom.session import materialize, small_batches

#: A table of so many rows of a few numbers each is broadcast at most; a longer one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def numbered(docs: DataFrame, text: str, make: Callable[[pa.Array], dict[str, pa.Array]], fields: str) -> DataFrame:
    """Written table of row (all columns of docs as they are), rid and what make() gives for each text of a batch.

    rid is unique and never null, follows the input's order within a partition, and is fixed once it is written. Nesting
    keeps the docs' columns from clashing with any others.
    """

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            row = batch.column(0)
            made = make(row.field(row.type.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([row, pa.array(range(at, at + len(row)), pa.int64()), *made.values()], ["row", "rid", *made])
            at += len(row)

    small_batches(docs.sparkSession)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return materialize(whole.mapInArrow(textops.lean(run), f"row {whole.schema['row'].dataType.simpleString()}, rid long, {fields}"), "rows")


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a written table of numbers is no longer than so many rows."""
    return F.broadcast(df) if df.count() <= rows else df
