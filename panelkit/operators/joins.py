"""Join helpers (J1-J7 are plain equi-joins; these add the size checks)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan (driver metadata only:
    file sizes for scans, propagated through the plan; no job runs)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else size.toString())


def broadcast_if_small(df: DataFrame, max_rows: int | None = None,
                       max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its estimated size is at most ``max_bytes``.

    Above the bound (or when the estimate is unknown, which Spark reports as
    huge) the frame is returned unchanged and Catalyst/AQE choose a shuffle
    join at run time.  Use it for dimension tables and literal lists, never
    for the fact side.  ``max_rows`` adds an exact bounded row check
    (a ``limit(max_rows + 1).count()`` job) for frames without statistics.
    """
    if estimated_bytes(df) <= max_bytes:
        return F.broadcast(df)
    if max_rows is not None and df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def literal_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal relation (name lists, alias tables, scenario grids)."""
    return spark.createDataFrame(rows, schema)
