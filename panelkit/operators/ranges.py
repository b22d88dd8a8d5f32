"""Positions, running sums, average ranks and exact quantiles of a whole
column without a task that holds all rows.  Quantiles are found by counting;
for the others:

Rows are range-partitioned by (keys, order) and written once, so that a
partition number is fixed; counts and sums per partition give each partition
its offset, and only the rows of one partition meet in a window.  The table of
offsets is bounded by keys x partitions and is the one thing broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def with_position(df: DataFrame, order, keys=(), total: str | None = None) -> DataFrame:
    """Add ``pos`` (1, 2, ... within ``keys`` by ``order``) and, with
    ``total``, ``before``: the sum of that column over the rows in front.

    ``order`` is a list of sort columns, which should end in a unique one
    where ties need a fixed order.  A NULL in ``total`` counts as 0; an empty
    frame stays empty."""
    keys = list(keys)
    add = F.coalesce(F.col(total), F.lit(0)) if total else F.lit(0)
    rows = cut_lineage(df.repartitionByRange(*keys, *order)
                       .withColumns({"_part": F.spark_partition_id(), "_add": add}))
    per = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_add").alias("_s"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
                         F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
                         F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_s0"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    here = Window.partitionBy(*keys, "_part").orderBy(*order)
    x = rows.join(F.broadcast(offsets), same)
    x = x.withColumn("pos", F.col("_n0") + F.row_number().over(here))
    if total:
        before = F.sum("_add").over(here.rowsBetween(Window.unboundedPreceding, -1))
        x = x.withColumn("before", F.col("_s0") + F.coalesce(before, F.lit(0)))
    return x.select(*df.columns, "pos", *(["before"] if total else []))


def with_average_rank(positioned: DataFrame, value: str, keys=(), name: str = "rank") -> DataFrame:
    """Add the average rank of equal ``value`` within ``keys`` to the rows of
    :func:`with_position` (W2, W3).  NULLs are one group of equals."""
    keys = list(keys)
    ties = positioned.groupBy(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], F.col(value).alias("_tv")) \
        .agg(((F.min("pos") + F.max("pos")) / 2.0).alias(name))
    same = F.col(value).eqNullSafe(F.col("_tv"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_t{i}"))
    return positioned.join(ties, same).select(*positioned.columns, name)


ACCURACY = 10_000       # of the sketch that proposes the next interval: its rank error is a part in so many


class _Wanted:
    """The value of one rank of a column: it lies in low..high, and ``below``
    values of the column are under low, ``inside`` ones in the interval."""

    def __init__(self, column: str, rank: int, low: float, high: float, count: int):
        self.column, self.rank, self.low, self.high, self.below, self.inside = column, rank, low, high, 0, count

    @property
    def found(self) -> bool:
        return self.low == self.high

    def proposal(self):
        """Two values between which the rank probably lies, around one near it."""
        v = F.col(self.column)
        at = (self.rank - self.below + 0.5) / self.inside
        probs = [min(max(at + step / ACCURACY, 0.0), 1.0) for step in (-2, 0, 2)]
        return F.percentile_approx(F.when((v >= self.low) & (v <= self.high), v), probs, ACCURACY)

    def counts(self, a: float, b: float):
        """What is under, and up to, the proposed values, and the neighbours outside."""
        v = F.col(self.column)
        return F.struct(F.count_if(v < a).alias("under"), F.count_if(v <= b).alias("upto"),
                        F.max(F.when(v < a, v)).alias("before"), F.min(F.when(v > b, v)).alias("behind"))

    def narrow(self, a: float, b: float, got) -> None:
        end = self.below + self.inside
        if self.rank < got["under"]:
            self.high, end = got["before"], got["under"]
        elif self.rank < got["upto"]:
            self.low, self.high, self.below, end = a, b, got["under"], got["upto"]
        else:
            self.low, self.below = got["behind"], got["upto"]
        self.inside = end - self.below


def quantiles(df: DataFrame, cols, probs) -> DataFrame:
    """Exact interpolated quantiles as one row: ``_q_<col>`` is the array of
    them in the order of ``probs`` (NULL elements where no value is left; NULL
    and NaN inputs take no part).

    Nothing is sorted or copied.  The values of the wanted ranks are enclosed:
    each round asks a sketch of the values inside an interval for a narrower one
    around the rank, and counts exactly what lies under and in it, for all
    columns and ranks in two aggregates.  An interval shrinks to a few parts in
    ``ACCURACY`` of its values a round, so a round does for ten thousand values,
    and four for 10^14.  ``df`` is read anew for each aggregate."""
    cols, probs = list(cols), [float(p) for p in probs]
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols])
    first = values.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in cols]).first()
    wanted: dict[tuple[str, int], _Wanted] = {}
    for c in cols:
        n = first[c]["n"]
        for p in probs if n else []:
            for rank in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                wanted[c, rank] = _Wanted(c, rank, first[c]["a"], first[c]["b"], n)
    while open_ := [w for w in wanted.values() if not w.found]:
        near = values.agg(*[w.proposal().alias(f"x{i}") for i, w in enumerate(open_)]).first()
        # a proposal that is the whole interval gives way to the one value in its midst
        between = [(x[1], x[1]) if (x[0], x[2]) == (w.low, w.high) else (x[0], x[2]) for x, w in zip(near, open_)]
        got = values.agg(*[w.counts(*between[i]).alias(f"x{i}") for i, w in enumerate(open_)]).first()
        for i, w in enumerate(open_):
            w.narrow(*between[i], got[i])

    def quantile(c, p):
        n = first[c]["n"]
        if not n:
            return None
        at = p * (n - 1)
        lo, hi, frac = wanted[c, math.floor(at)].low, wanted[c, math.ceil(at)].low, at - math.floor(at)
        return lo if frac == 0 else lo * (1 - frac) + hi * frac

    return df.sparkSession.createDataFrame([tuple([quantile(c, p) for p in probs] for c in cols)],
                                           ", ".join(f"`_q_{c}` array<double>" for c in cols))
