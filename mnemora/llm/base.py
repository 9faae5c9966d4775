"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import ensure_checkpoint_dir, remove, scope, written, written_to

__all__ = ["column", "ensure_checkpoint_dir", "map_slices", "read_table", "remove", "scope", "slices", "whole_text", "written", "written_to"]

#: Rows that a Python worker handles, and gives back, at a time.
SLICE_ROWS = 256
#: Text bytes after which a slice ends early, so that very long texts do not pile up.
SLICE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(name: str) -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch that are small in rows and in text bytes."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= SLICE_ROWS or size + n > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_slices(df: DataFrame, text: str, make: Callable[[pa.RecordBatch], Iterable[dict | pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over small slices. `make` gives, for a slice, the output columns by name or record
    batches; a worker never holds the output of more than one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield from make(part)
        # the worker stays for other tasks; what Arrow held for this one need not
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
