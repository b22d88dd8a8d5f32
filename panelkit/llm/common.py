"""Shared helpers: null-safe document columns, shared-folder checkpoints and
Arrow batch plumbing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

__all__ = ["cut_lineage", "doc_columns", "text_bytes", "columns_of", "record_batches", "hash_sample", "shuffle_width"]


def doc_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id long`` and ``text string`` of ``docs``: a null text counts
    as empty, and other columns (whatever their names) are not carried."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shuffle_width(df: DataFrame) -> int:
    """The session's shuffle partition count (the cluster's own setting)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def columns_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The columns of each Arrow batch, as Python lists."""
    for rb in batches:
        yield tuple(c.to_pylist() for c in rb.columns)


def text_bytes(text) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def record_batches(rows: Iterable[tuple], fields: pa.Schema, max_rows: int = 4096,
                   max_chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of bounded rows and characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str | bytes))
        if len(held) >= max_rows or chars >= max_chars:
            yield _batch_of(held, fields)
            held, chars = [], 0
    if held:
        yield _batch_of(held, fields)


def _batch_of(rows, fields):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows, drawn by a hash of ``keys`` (all, if fewer): a
    threshold on the hash, so that no more than these leave the tasks."""
    total = df.count()
    if total <= rows:
        return df
    parts = 1 << 20
    cut = int(parts * 0.95 * rows / total)
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(parts)) < cut).limit(rows)
