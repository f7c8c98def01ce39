"""Small helpers shared by the operators: column selection, bounded batches, Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: text bytes turned into Python objects at a time
SLICE_BYTES = 4 << 20


def quoted(name: str):
    """Column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that are needed, so no other column can clash with internal names."""
    return df.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow form of a flat schema; tasks have no session that could parse it."""

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else _ARROW[name]

    return pa.schema([(name, kind(of)) for name, of in (field.split() for field in ddl.split(","))])


def map_slices(df: DataFrame, factory: Callable, ddl: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``factory()`` runs once per task and returns a function from a bounded batch to columns.

    The rows of ``df`` need a ``text`` column. Tasks keep no rows between batches, so memory
    depends on ``limit`` and on the longest single text only.
    """

    def run(batches):
        schema, work = arrow_schema(ddl), factory()
        for batch in batches:
            for part in slices(batch, limit=limit):
                yield pa.RecordBatch.from_pydict(work(part), schema=schema)

    return df.mapInArrow(run, ddl)


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())
