"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged as materialise  # noqa: F401

#: Words are runs of anything but ASCII white space; bytes.split() cuts exactly there.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20, most: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about `limit` bytes of `column`, so memory does not follow the batch size.

    A single longer value is passed whole, in a batch of its own.
    """
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (total + (n or 0) > limit or i - start >= most):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if start < len(lengths):
            yield batch.slice(start)


def text_tag() -> Column:
    """Tells rows apart that share a doc_id, or have none, but not a text; 64 bits, as such rows can be many."""
    return F.xxhash64(F.col("text").cast("string"))


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs' columns as one struct, `row`, and further columns: own names then clash with none of theirs.

    select("row.*") gives the columns back.
    """
    return docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in more.items()])
