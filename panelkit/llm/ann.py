"""Nearest neighbours over randomly rotated one-bit codes (operator 4).

Every vector is scaled to length one, rotated by one random orthogonal matrix
and reduced to the signs of its components: one bit a dimension, and the
correction scalar ``c = <signs / sqrt(D), rotated vector>``.  For a query q,
rotated likewise, ``<signs / sqrt(D), q> / c`` is an unbiased estimate of the
cosine, off by at most ``EPSILON * sqrt((1 - c^2) / (c^2 (D - 1)))`` but for a
small probability.  A block of queries meets a chunk of codes: the best
estimates are computed exactly first, and then every vector whose estimate
plus error bound reaches the worst of the best k is reranked on the original
vectors in double precision.

Chunks and query blocks have fixed sizes, each pair of them is one row of
work under its own key, and only k rows per query and chunk leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

K = 5
EPSILON = 2.5
CHUNK_ROWS = 8_192
BLOCK_QUERIES = 8_192   # copies of the rows and of the queries cost alike at these sizes
PROBE = 4               # times k estimates are computed exactly for a first bound
ROTATION_SEED = 20


def rotation(dim: int, seed: int = ROTATION_SEED) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalar of each vector."""
    unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    turned = unit @ rot
    bits = turned > 0
    scalar = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])
    return np.packbits(bits, axis=1), scalar


def search(ids, rows, vectors, bits, scalar, query_rows, queries, rot, k=K, epsilon=EPSILON):
    """``(query, candidate, score)`` arrays, as places in the given ones, of the
    k nearest of a chunk for each query, and the number of vectors that were
    reranked.  ``rows`` and ``query_rows`` tell which candidate is the query."""
    dim = vectors.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    unit_q = queries / np.sqrt((queries * queries).sum(1))[:, None]
    turned = (unit_q @ rot).astype(np.float32)
    with np.errstate(divide="ignore"):
        error = epsilon * np.sqrt(np.maximum(1 - scalar ** 2, 0) / (scalar ** 2 * max(dim - 1, 1)))
    norms = np.sqrt((vectors * vectors).sum(1))
    qnorms = np.sqrt((queries * queries).sum(1))
    per_row = 1 / (scalar * np.sqrt(dim))
    out_q, out_c, out_s, reranked = [], [], [], 0
    for a in range(0, len(queries), 128):
        estimates = (turned[a:a + 128] @ signs.T) * per_row
        for r in range(len(estimates)):
            q = a + r
            est = estimates[r]
            est[rows == query_rows[q]] = -np.inf
            live = np.flatnonzero(np.isfinite(est))
            if not len(live):
                continue
            exact = lambda rows: (vectors[rows] * queries[q]).sum(1) / (norms[rows] * qnorms[q])
            if len(live) > PROBE * k:
                probe = np.argpartition(-est, PROBE * k)[:PROBE * k]
                probe = probe[np.isfinite(est[probe])]
                bound = np.sort(exact(probe))[-k] if len(probe) >= k else -np.inf
                live = np.flatnonzero((est + error >= bound) & np.isfinite(est))
                live = np.union1d(live, probe)
            score = exact(live)
            reranked += len(live)
            best = live[np.lexsort((ids[live], -score))[:k]]
            out_q.append(np.full(len(best), q))
            out_c.append(best)
            out_s.append(exact(best))
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return cat(out_q, np.int64), cat(out_c, np.int64), cat(out_s, np.float64), reranked


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``row, id, v array<double>``: every row that takes part, under a number
    of its own.

    Left out: null ids, null and zero vectors, and vectors with null or
    non-finite components.  Rows that share an id are vectors of their own.
    """
    v = F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)).select(F.monotonically_increasing_id().alias("row"), "id", "v")


def nearest(vectors: DataFrame, queries, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
            epsilon: float = EPSILON, chunk_rows: int = CHUNK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` nearest rows by cosine of every row that ``queries`` (a
    condition on the id column, as a function of it) picks.

    Returns ``query_id, rank, vec_id, score double``; all candidates if fewer
    than k, ties to the smaller id.  Candidates are all rows but the query's own
    (another row under the query's id is one), of the query's length: vectors of
    each length are a set of their own.  Of several queries under one id each
    has its ranks.  What :func:`usable` leaves out takes no part; an empty table
    gives no rows; other columns are ignored.
    """
    rows = cut_lineage(usable(vectors, id_col, vec_col))
    spark = rows.sparkSession
    total = rows.count()
    picked = rows.filter(queries(F.col("id")))
    n_chunks = max(1, -(-total // chunk_rows))
    n_blocks = max(1, -(-picked.count() // block_queries))
    seeded = spark.sparkContext.broadcast(ROTATION_SEED)

    def gather(part: DataFrame, groups: int, name: str) -> DataFrame:
        """Rows as binary chunks of a bounded number of vectors of one length."""
        key = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias(name)
        return part.select(key, F.size("v").alias("dim"), "row", "id", "v").groupBy(name, "dim") \
            .agg(F.sort_array(F.collect_list(F.struct("id", "row", "v"))).alias("m"))

    fields = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("vectors", pa.binary()), ("bits", pa.binary()),
                        ("scalars", pa.binary()), ("dim", pa.int32())])

    def coded(batches):
        for rb in batches:
            for row in rb.to_pylist():
                ids, rows_ = (np.array([m[c] for m in row["m"]], np.int64) for c in ("id", "row"))
                vecs = np.array([m["v"] for m in row["m"]], np.float64)
                bits, scalar = encode(vecs, rotation(vecs.shape[1], seeded.value))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], f.type) for x, f in zip((row["part"], ids.tobytes(), rows_.tobytes(), vecs.tobytes(), bits.tobytes(),
                                                            scalar.tobytes(), vecs.shape[1]), fields)], schema=fields)

    schema = "part int, ids binary, rows binary, vectors binary, bits binary, scalars binary, dim int"
    chunks = cut_lineage(gather(rows, n_chunks, "part").mapInArrow(coded, schema))
    blocks = cut_lineage(gather(picked, n_blocks, "part").mapInArrow(coded, schema)).select(
        "dim", F.col("part").alias("block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"),
        F.col("vectors").alias("q_vectors"))
    # the stated query set in blocks: every block meets every chunk once, and
    # each meeting is a key of its own, so no block or chunk fills a task
    cells = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asked = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    grid = cells.join(asked.hint("shuffle_hash"), ["dim", "part", "block"])

    def run(batches):
        out = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for rb in batches:
            for row in rb.to_pylist():
                dim = row["dim"]
                read = lambda c, kind: np.frombuffer(row[c], kind)
                ids, q_ids, q_rows = (read(c, np.int64) for c in ("ids", "q_ids", "q_rows"))
                q, c, s, _ = search(ids, read("rows", np.int64), read("vectors", np.float64).reshape(-1, dim),
                                    read("bits", np.uint8).reshape(len(ids), -1), read("scalars", np.float64),
                                    q_rows, read("q_vectors", np.float64).reshape(-1, dim),
                                    rotation(dim, seeded.value), k, epsilon)
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[q]), pa.array(q_ids[q]), pa.array(ids[c]), pa.array(s)], schema=out)

    found = grid.mapInArrow(run, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
