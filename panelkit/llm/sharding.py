"""Sharding by minimax contiguous partition (operator 11), native.

Rows of one group (equal texts) are an atom that no cut may split.  Atoms stand
in the order of their key's hash; a shard is a run of neighbouring atoms, and
the largest shard is to be as small as it can be.  A capacity is feasible if
filling shards greedily, each as far as it goes, reaches the end; the smallest
feasible capacity is found by binary search, and the greedy cuts at it are the
shards.  An atom larger than an equal share of what is left gets a shard of its
own before that (at most ``shards - 1`` of them), so that it doesn't set the
capacity of all others.

The running sizes of all atoms stay in Spark.  The driver keeps landmarks of
them: a check that only knows landmarks is too strict, one that may also cut
anywhere in an unseen gap is too lenient, and between the smallest capacities
of the two lies the true one.  Each round asks Spark, in one map-side combined
aggregate, for the landmarks of at most ``GRID`` cells inside the gaps that the
cuts in question may fall into; it ends when both checks give the same cuts.
So the driver's memory is bounded by GRID, whatever the number of atoms.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import with_position
from .common import cut_lineage

SHARDS = 24
ROW_BYTES = 8               # size of a row beside its text
GRID = 1 << 15              # cells of running sizes that a round brings to the driver


class Landmarks:
    """Known running sizes of the line of atoms, 0 and the end among them."""

    def __init__(self, total: int):
        self.at = [0, total]
        self.unseen = [total > 0]           # whether atoms may end inside the gap behind at[i]

    @property
    def total(self) -> int:
        return self.at[-1]

    def greedy(self, capacity: int, shards: int, lenient: bool) -> list[int]:
        """Ends of the shards when each is filled as far as it goes."""
        out, p = [], 0
        for _ in range(shards):
            reach = min(p + capacity, self.total)
            i = bisect_right(self.at, reach) - 1
            p = reach if lenient and i < len(self.unseen) and self.unseen[i] else self.at[i]
            out.append(p)
        return out

    def smallest(self, shards: int, low: int, high: int, lenient: bool) -> int:
        """The smallest feasible capacity in low..high (high is feasible)."""
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, lenient)[-1] == self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def gaps(self, low: list[int], high: list[int]) -> list[tuple[int, int]]:
        """Unseen gaps that a cut between ``low[k]`` and ``high[k]`` may be in."""
        hit = set()
        for a, b in zip(low, high):
            i = bisect_right(self.at, a) - 1
            while i < len(self.unseen) and self.at[i] <= b:
                if self.unseen[i]:
                    hit.add(i)
                i += 1
        return [(self.at[i], self.at[i + 1]) for i in sorted(hit)]

    def learn(self, gaps: list[tuple[int, int]], cells: list[tuple[int, int, int]]) -> None:
        """``cells``: least, greatest and number of the running sizes of each
        cell inside the ``gaps``; a cell may reach over several gaps."""
        marks = dict(zip(self.at, [*self.unseen, False]))
        starts = [a for a, _ in gaps]
        marks.update((a, False) for a in starts)
        for least, greatest, n in cells:
            marks[greatest] = False
            marks[least] = n > 2
            marks.update((a, n > 2) for a in starts[bisect_right(starts, least):bisect_right(starts, greatest)])
        self.at = sorted(marks)
        self.unseen = [marks[a] for a in self.at[:-1]]


def minimax_cuts(line: DataFrame, end: str, total: int, largest: int, shards: int) -> list[int]:
    """Ends of the shards: greedy cuts of the running sizes ``end`` of ``line``
    at the smallest capacity for which ``shards`` shards reach ``total``."""
    known = Landmarks(total)
    floor = max(largest, -(-total // shards))
    while True:
        high = known.smallest(shards, floor, total, lenient=False)
        low = known.smallest(shards, floor, high, lenient=True)
        strict, free = known.greedy(low, shards, False), known.greedy(high, shards, True)
        if strict == free:
            return strict
        gaps = known.gaps(strict, free)
        inside = [(F.col(end) > a) & (F.col(end) < b) for a, b in joined(gaps)]
        width = max(1, sum(b - a for a, b in gaps) // GRID)
        wanted = inside[0]
        for x in inside[1:]:
            wanted = wanted | x
        cells = line.filter(wanted).groupBy(F.expr(f"{end} div {width}")) \
            .agg(F.min(end).alias("a"), F.max(end).alias("b"), F.count(F.lit(1)).alias("n")).collect()
        known.learn(gaps, [(r["a"], r["b"], r["n"]) for r in cells])


def joined(gaps: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Gaps with neighbours made one (the mark between them is known already)."""
    out: list[tuple[int, int]] = []
    for a, b in gaps:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _total(terms: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for t in terms:
        out = out + t
    return out


def shard_rows(rows: DataFrame, group: str, size: str, order: list[str], shards: int = SHARDS) -> DataFrame:
    """``rows`` with ``shard int`` (0 to ``shards - 1``) and ``slot long``
    (place in the shard, gapless from 0).

    ``group`` is the atoms' key (not null), ``size`` a positive long; rows of an
    atom follow ``order``, and rows equal in all of these stand in any order.
    Fewer atoms than shards leave shards empty; an empty frame stays empty.
    Three shuffles of ``rows`` as they come in (carry no texts): a range sort,
    the windows in its ranges, and a map-side combined sum by atom.
    """
    kept = rows.columns
    named = rows.select(*kept, F.col(group).alias("_g"), F.col(size).cast("long").alias("_z"),
                        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                        F.monotonically_increasing_id().alias("_tie"))
    # written once before the ranges are drawn, so that nothing is derived twice
    line = with_position(cut_lineage(named), ["_g", *[f"_o{i}" for i in range(len(order))], "_tie"], total="_z")
    line = cut_lineage(line.select(*kept, "_g", "_z", "pos", "before"))
    atoms = cut_lineage(line.groupBy("_g").agg(F.sum("_z").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                                               F.min("before").alias("start"), F.min("pos").alias("first")))
    total = atoms.agg(F.sum("bytes")).first()[0] or 0
    own, rest, left, largest = [], total, shards, 0
    for r in atoms.orderBy(F.desc("bytes"), "_g").limit(shards).collect():
        if left > 1 and r["bytes"] * left > rest:
            own.append(r)
            rest, left = rest - r["bytes"], left - 1
        else:
            largest = r["bytes"]
            break
    # atoms with a shard of their own are taken out of the line
    def moved(at: str, start: str, width: str) -> Column:
        return F.col(at) - _total([F.when(F.col(at) >= r[start] + r[width], F.lit(r[width])).otherwise(F.lit(0))
                                   for r in own])

    others = atoms.filter(~F.col("start").isin([r["start"] for r in own])) if own else atoms
    ends = others.select((moved("start", "start", "bytes") + F.col("bytes")).alias("end"))
    cuts = minimax_cuts(ends, "end", rest, largest, left)
    place = moved("before", "start", "bytes")
    shard = F.lit(len(own)) + _total([(place >= c).cast("long") for c in cuts[:-1]])
    for i, r in enumerate(own):
        shard = F.when((F.col("before") >= r["start"]) & (F.col("before") < r["start"] + r["bytes"]), F.lit(i)).otherwise(shard)
    dealt = line.withColumns({"_s": shard.cast("int"), "_p": moved("pos", "first", "rows")})
    starts = dict(dealt.groupBy("_s").agg(F.min("_p")).collect())           # one row per shard
    first = F.coalesce(*[F.when(F.col("_s") == s, F.lit(p)) for s, p in starts.items()], F.lit(0))
    return dealt.select(*kept, F.col("_s").alias("shard"), (F.col("_p") - first).cast("long").alias("slot"))


def _hashed(docs: DataFrame) -> tuple[Column, Column]:
    """Size and atom key of a document: bytes of its text and of the row, and
    the text's SHA-256 (null counts as empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (F.octet_length(text) + ROW_BYTES).cast("long"), F.unhex(F.sha2(text.cast("binary"), 256))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row
    (and ``atom``, the hash of its text).

    The law is ``bytes``: no shard is larger than it must be.  Rows of equal
    texts (by SHA-256; null and empty texts are equal) lie in one shard, in order
    of doc_id, nulls first; repeated rows are rows of their own; other columns
    are ignored.  ``grown_shard`` is null, as another number of shards moves the
    cuts.  A document is read once; what is sorted is its hash, size and id.
    """
    size, atom = _hashed(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"),
                       F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
                       atom.alias("atom"))
    dealt = shard_rows(rows, "atom", "size", ["doc_id"], shards)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "atom")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """Write ``docs`` with all columns as one folder per shard.

    A shard is a range of hashes (a shard of one atom may lie inside another
    one's range), so a row's shard follows from its own text and at most
    ``shards`` ranges; texts are shuffled once, by range, so that a large shard
    is written by many tasks."""
    ranges = cut_lineage(shard_documents(docs, shards)).groupBy("shard") \
        .agg(F.min("atom").alias("a"), F.max("atom").alias("b")).collect()         # one row per shard
    _, atom = _hashed(docs)
    shard = F.coalesce(*[F.when((F.col("_atom") >= F.lit(r["a"])) & (F.col("_atom") <= F.lit(r["b"])), F.lit(r["shard"]))
                         for r in sorted(ranges, key=lambda r: r["a"] != r["b"])], F.lit(0))
    docs.withColumn("_atom", atom).withColumn("shard", shard).repartitionByRange("shard", "_atom", "doc_id") \
        .sortWithinPartitions("shard", "_atom", "doc_id").drop("_atom").write.partitionBy("shard").parquet(folder)
