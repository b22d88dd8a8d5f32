"""Naming of values by sorting, shared by the levels of the exact dedup.

``with_names`` gives equal values equal integers and different values
different ones, moving each value once: rows are dealt into buckets by a hash
of their value, every bucket is sorted by the value itself, and a name is the
bucket and the value's dense rank in it.  A value held by a large share of all
rows would fill one bucket; the HOT_VALUES most frequent hashes (found by a
count with map-side combining) are therefore named on their own, once per
distinct value, and joined back by broadcast: at most HOT_VALUES values of
bounded width.  Every other hash has at most 1/HOT_VALUES of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width

HOT_VALUES = 1_000
HOT_ROWS = 256              # a value with fewer rows is never hot
BUCKETS_PER_PARTITION = 32
RANK_BITS = 40


def with_names(rows: DataFrame, value: list[str], name: str = "name") -> DataFrame:
    """``rows`` without the ``value`` columns, with ``name long``."""
    kept = [c for c in rows.columns if c not in value]
    hashed = rows.withColumn("__h", F.xxhash64(*value))
    top = (hashed.groupBy("__h").count().filter(F.col("count") >= HOT_ROWS)
           .orderBy(F.desc("count"), "__h").limit(HOT_VALUES).collect())
    hot = [r["__h"] for r in top]
    buckets = shuffle_width(rows) * BUCKETS_PER_PARTITION
    ranked = Window.partitionBy("__b").orderBy(*value)

    def named(part):
        return (part.withColumn("__b", F.pmod("__h", F.lit(buckets)))
                .withColumn(name, F.shiftleft(F.col("__b"), RANK_BITS) + F.dense_rank().over(ranked)))

    cold = named(hashed.filter(~F.col("__h").isin(hot)) if hot else hashed).select(*kept, name)
    if not hot:
        return cold
    is_hot = hashed.filter(F.col("__h").isin(hot))
    # hot names lie above all bucket names
    base = (buckets + 1) << RANK_BITS
    names = (is_hot.select("__h", *value).distinct()
             .withColumn(name, F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("__h", *value)) + F.lit(base)))
    back = is_hot.join(F.broadcast(names), ["__h", *value]).select(*kept, name)
    return cold.unionByName(back)
