"""Exact cosine top-k with pivot bounds.

On unit vectors the inner product is a distance: |u - w|^2 = |u|^2 + |w|^2 - 2uw.
Every corpus vector belongs to its nearest pivot (``PIVOTS`` vectors drawn by
hash) and blocks are runs of vectors of one pivot in order of their distance
from it.  A query at distance a from a pivot is, by the triangle inequality, no
nearer to a block [near, far] of it than max(a - far, near - a), which bounds
the block's scores from above.

A query is first scored against the blocks nearest to it that hold enough
vectors; its k-th score then rules out every block whose bound is below it.
What is left is scored as products of matrices: a task meets one block and a
batch of the queries that need it.  Bounds only skip work; what they can't rule
out is scored, so the result is that of the full comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

PIVOTS = 64
BLOCK_ROWS = 4_096
MAX_BLOCKS = 500_000        # the index of blocks goes to all tasks; larger corpora get larger blocks
QUERY_ROWS = 512            # queries that meet a block together
FIRST_ROWS = 8              # vectors a query is scored against first, times k
SLACK = 1e-6                # of distances: more than rounding can make up
SCORE_SLACK = 1e-9


def unit_rows(column) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of a batch's vectors, and the unit vectors one after another (a
    zero vector stays zero)."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    norm = np.sqrt(np.bincount(row, flat * flat, len(lengths)))
    return lengths, flat / np.where(norm > 0, norm, 1.0)[row]


def by_length(column):
    """(length, rows, matrix of their unit vectors) for every length in a batch."""
    lengths, flat = unit_rows(column)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, flat[ends[at][:, None] + np.arange(d)]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


class Index:
    """What every task knows: pivots by vector length, and the blocks."""

    def __init__(self, pivots: dict[int, np.ndarray], blocks: list):
        self.pivots = pivots
        self.of_length = {}
        for d in {r["dim"] for r in blocks}:
            rows = [r for r in blocks if r["dim"] == d]
            self.of_length[d] = {c: np.array([r[c] for r in rows]) for c in ("block", "pivot", "near", "far", "n")}

    def least(self, d: int, w: np.ndarray) -> np.ndarray:
        """Least distances of the queries ``w`` from the blocks of their length."""
        b = self.of_length[d]
        if d not in self.pivots:
            return np.zeros((len(w), len(b["block"])))
        a = distances(w, self.pivots[d])[:, b["pivot"]]
        return np.maximum(np.maximum(a - b["far"], b["near"] - a) - SLACK, 0)

    def first(self, d: int, least: np.ndarray, wanted: int) -> np.ndarray:
        """Which blocks a query (a row of ``least``) is scored against first:
        the nearest ones until they hold ``wanted`` vectors."""
        order = np.argsort(least, axis=1, kind="stable")
        held = np.cumsum(self.of_length[d]["n"][order], axis=1)
        out = np.zeros(least.shape, bool)
        np.put_along_axis(out, order, held - self.of_length[d]["n"][order] < wanted, 1)
        return out


def _items(batches, index: Index, needs):
    """Meetings of blocks and queries: (block, dim, rows, queries, vectors)."""
    for rb in batches:
        rows, ids = rb.column("row").to_numpy(zero_copy_only=False), rb.column("query")
        for d, at, w in by_length(rb.column("v")):
            if d not in index.of_length:
                continue
            blocks = index.of_length[d]["block"]
            some = min(QUERY_ROWS, max(1, 4_000_000 // max(len(blocks), len(index.pivots.get(d, [])))))
            for i in range(0, len(at), some):
                part = slice(i, i + some)
                need = needs(rb, at[part], d, index.least(d, w[part]))
                for j in np.flatnonzero(need.any(0)):
                    q = np.flatnonzero(need[:, j])
                    here = at[part][q]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(blocks[j])]), pa.array([d], pa.int32()), pa.array([rows[here].tolist()], pa.list_(pa.int64())),
                         pa.ListArray.from_arrays(pa.array([0, len(here)], pa.int32()), ids.take(pa.array(here))),
                         pa.array([w[part][q].tobytes()], pa.binary())], names=["block", "dim", "rows", "queries", "vectors"])


def best_of(w: np.ndarray, x: np.ndarray, ids: list, k: int):
    """Per query the k best of a block, (score, id) by score, then smaller id
    (null first).  Scores are sums taken the same way for every pair, so equal
    vectors tie."""
    rough = w @ x.T
    for q, row in enumerate(rough):
        cut = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
        at = np.flatnonzero(row >= cut - SCORE_SLACK)
        score = (x[at] * w[q]).sum(1)
        yield sorted(zip((-score).tolist(), ((ids[i] is not None, ids[i]) for i in at)))[:k]


class Search:
    """``hits`` (query, rank, id, score) and what it took: :meth:`work`."""

    def __init__(self, hits: DataFrame, items: DataFrame, blocks: DataFrame, queries: DataFrame):
        self.hits, self._items, self._blocks, self._queries = hits, items, blocks, queries

    def work(self) -> tuple[int, int]:
        """Scored pairs, and all pairs of a query and a vector of its length."""
        sizes = self._blocks.select("block", "n")
        scored = self._items.select("block", F.size("rows").alias("q")).join(sizes, "block").agg(F.sum(F.col("q") * F.col("n")))
        n = self._blocks.groupBy("dim").agg(F.sum("n").alias("n"))
        q = self._queries.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("q"))
        return scored.first()[0] or 0, n.join(q, "dim").agg(F.sum(F.col("n") * F.col("q"))).first()[0] or 0


def search(corpus: DataFrame, queries: DataFrame, id_col: str, vec: str, k: int) -> Search:
    """The ``k`` nearest of ``corpus`` by cosine for every row of ``queries``,
    ties to the smaller id (null first).

    Vectors that are null or hold null or non-finite components take no part,
    zero vectors score 0, vectors of different length never meet.  Repeated rows of the corpus are vectors of their own, repeated
    rows of the queries are queries of their own.
    """
    k = max(1, int(k))
    as_double = F.transform(vec, lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    given = corpus.select(F.col(id_col).alias("id"), as_double.alias("v")).filter(F.col("v").isNotNull() & finite)
    drawn = given.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(PIVOTS).collect()
    pivots = {}
    for r in drawn:
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {d: by_length_of(v) for d, v in pivots.items()}
    blocks = _blocks(given, pivots, max(BLOCK_ROWS, -(-given.count() // MAX_BLOCKS)))
    index = Index(pivots, blocks.select("block", "dim", "pivot", "near", "far", "n").collect())
    shared = corpus.sparkSession.sparkContext.broadcast(index)
    asked = cut_lineage(queries.select(F.col(id_col).alias("query"), as_double.alias("v"))
                        .filter(F.col("v").isNotNull() & finite).withColumn("row", F.monotonically_increasing_id()))
    item_ddl = T.StructType([T.StructField("block", T.LongType()), T.StructField("dim", T.IntegerType()),
                             T.StructField("rows", T.ArrayType(T.LongType())),
                             T.StructField("queries", T.ArrayType(asked.schema["query"].dataType)),
                             T.StructField("vectors", T.BinaryType())])
    wanted = FIRST_ROWS * k

    def first_items(batches):
        index = shared.value
        yield from _items(batches, index, lambda rb, at, d, least: index.first(d, least, wanted))

    def more_items(batches):
        index = shared.value

        def needs(rb, at, d, least):
            floor = rb.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)[at]
            most = (2 - least * least) / 2 + SCORE_SLACK
            return ~index.first(d, least, wanted) & ~(most < floor[:, None])

        yield from _items(batches, index, needs)

    fields = T.StructType([T.StructField("row", T.LongType()), T.StructField("query", asked.schema["query"].dataType),
                           T.StructField(id_col, given.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def score(batches):
        for rb in batches:
            q_type, id_type = rb.schema.field("queries").type.value_type, rb.schema.field("ids").type.value_type
            for dim, rows, asked_ids, vectors, ids, matrix in zip(*(rb.column(c).to_pylist() for c in (
                    "dim", "rows", "queries", "vectors", "ids", "matrix"))):
                w = np.frombuffer(vectors).reshape(len(rows), dim)
                x = np.frombuffer(matrix).reshape(len(ids), dim)
                out = [(r, q, i[1], -s) for r, q, best in zip(rows, asked_ids, best_of(w, x, ids, k)) for s, i in best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), q_type, id_type, pa.float64()))],
                    names=["row", "query", id_col, "score"])

    def scored(items):
        return items.join(blocks.select("block", "ids", "matrix"), "block") \
            .select("dim", "rows", "queries", "vectors", "ids", "matrix").mapInArrow(score, fields)

    def top(found):
        order = Window.partitionBy("row").orderBy(F.desc("score"), id_col)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = cut_lineage(asked.select("row", "query", "v").mapInArrow(first_items, item_ddl))
    found = cut_lineage(top(scored(first)))
    floors = found.filter(F.col("rank") == k).select("row", F.col("score").alias("floor"))
    more = cut_lineage(asked.join(floors, "row", "left").select("row", "query", "v", "floor").mapInArrow(more_items, item_ddl))
    hits = top(found.drop("rank").unionByName(scored(more))).select("query", "rank", id_col, "score")
    return Search(hits, first.unionByName(more), blocks, asked)


def by_length_of(vectors: list) -> np.ndarray:
    """Unit vectors of equally long ones."""
    x = np.array(vectors, np.float64).reshape(len(vectors), -1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)


def _blocks(given: DataFrame, pivots: dict[int, np.ndarray], block_rows: int) -> DataFrame:
    """``block, dim, pivot, near, far, n, ids, matrix``, written once.  Rows are
    dealt out by ranges of (length, pivot, distance, id, tie), so that a vector
    that a large part of the corpus repeats is cut into blocks as well."""
    schema = T.StructType([given.schema["id"], T.StructField("dim", T.IntegerType()), T.StructField("pivot", T.IntegerType()),
                           T.StructField("away", T.DoubleType()), T.StructField("unit", T.BinaryType()),
                           T.StructField("tie", T.LongType())])

    def placed(batches):
        for rb in batches:
            for d, at, x in by_length(rb.column("v")):
                away = distances(x, pivots[d]) if d in pivots else np.zeros((len(x), 1))
                pivot = away.argmin(1)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [rb.column("id").take(take), pa.array(np.full(len(at), d, np.int32)), pa.array(pivot.astype(np.int32)),
                     pa.array(away[np.arange(len(at)), pivot]), pa.array([row.tobytes() for row in x], pa.binary()),
                     rb.column("tie").take(take)], names=["id", "dim", "pivot", "away", "unit", "tie"])

    out = T.StructType([T.StructField("block", T.LongType()), *schema.fields[1:3], T.StructField("near", T.DoubleType()),
                        T.StructField("far", T.DoubleType()), T.StructField("n", T.LongType()),
                        T.StructField("ids", T.ArrayType(given.schema["id"].dataType)), T.StructField("matrix", T.BinaryType())])

    def packed(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        held = []

        def block(rows):
            _, dim, pivot, away, unit = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([dim[0]], pa.int32()), pa.array([pivot[0]], pa.int32()), pa.array([min(away)]),
                 pa.array([max(away)]), pa.array([len(rows)]), pa.array([[r[0] for r in rows]], pa.list_(kind)),
                 pa.array([b"".join(unit)], pa.binary())], names=out.names)

        for rb in batches:
            kind = rb.schema.field("id").type
            for row in zip(*(rb.column(c).to_pylist() for c in ("id", "dim", "pivot", "away", "unit"))):
                if held and (len(held) >= block_rows or held[0][1:3] != row[1:3]):
                    yield block(held)
                    number += 1
                    held = []
                held.append(row)
        if held:
            yield block(held)

    rows = given.withColumn("tie", F.monotonically_increasing_id()).mapInArrow(placed, schema)
    order = ["dim", "pivot", "away", "id", "tie"]
    return cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, out))
