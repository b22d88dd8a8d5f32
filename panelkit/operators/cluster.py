"""Silhouette, nearest centres, PCA and centroid profiles.

A point stays one row throughout: its vector meets the whole matrix of cluster
sums or centres inside an Arrow step.  These matrices are sums over all points
(partial sums per task) or given centres; they are what goes to the tasks, and
their size is checked.  K-Means itself is in :mod:`.kmeans`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

MAX_MATRIX = 8_000_000      # numbers of a matrix of centres that is sent to the tasks
MERGE_WAYS = 32


def _matrix(rows: DataFrame, what: str) -> list:
    """The rows of a small matrix, at most MAX_MATRIX."""
    got = rows.limit(MAX_MATRIX + 1).collect()
    if len(got) > MAX_MATRIX:
        raise ValueError(f"{what}: more than {MAX_MATRIX} numbers of centres")
    return got


def _vectors(column: pa.Array) -> np.ndarray:
    """A batch's vectors of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def silhouette_sq(points: DataFrame, id_col: str, vec: str, labels: DataFrame, group: str | None = None) -> DataFrame:
    """Squared-Euclidean silhouette of every point per ``group`` (e.g. k), as
    ``id, [group], a, b, s``: mean distance within its cluster, least mean
    distance to another one, and (b - a) / max(a, b).

    For point x and cluster C: mean d2(x, C) = |x|^2 - 2 x.S_C/n_C + Q_C/n_C
    with S_C the vector sum and Q_C the sum of |y|^2; the own cluster uses
    n_C - 1 (the point's own zero distance is excluded); singletons, and points
    without another cluster, score 0.
    """
    g = F.col(group) if group else F.lit(0)
    rows = labels.select(id_col, g.alias("g"), F.col("cluster").alias("c")).join(
        points.select(id_col, F.transform(vec, lambda x: x.cast("double")).alias("v")), id_col)

    def partial(batches):
        total = {}
        for rb in batches:
            if not rb.num_rows:
                continue
            x = _vectors(rb.column("v"))
            keys = list(zip(rb.column("g").to_pylist(), rb.column("c").to_pylist()))
            numbered = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            at = np.array([numbered[k] for k in keys])
            sums = np.zeros((len(numbered), x.shape[1] + 2))
            np.add.at(sums, at, np.concatenate([np.ones((len(x), 1)), (x * x).sum(1, keepdims=True), x], 1))
            for k, i in numbered.items():
                total[k] = total[k] + sums[i] if k in total else sums[i]
        for (gk, ck), row in total.items():
            n = len(row)
            yield pa.RecordBatch.from_arrays([pa.array([gk] * n, rb.schema.field("g").type),
                                              pa.array([ck] * n, rb.schema.field("c").type),
                                              pa.array(np.arange(n, dtype=np.int32)), pa.array(row)], names=["g", "c", "j", "value"])

    kinds = T.StructType([rows.schema["g"], rows.schema["c"]])
    summed = rows.select("g", "c", "v").mapInArrow(
        partial, T.StructType([*kinds, T.StructField("j", T.IntegerType()), T.StructField("value", T.DoubleType())])) \
        .groupBy("g", "c", "j").agg(F.sum("value").alias("value"))
    flat = {}
    for r in _matrix(summed, "silhouette"):
        flat.setdefault(r["g"], {}).setdefault(r["c"], {})[r["j"]] = r["value"]
    clusters = {}
    for gk, by_cluster in flat.items():
        m = np.array([[row[j] for j in range(len(row))] for row in by_cluster.values()])
        clusters[gk] = {c: i for i, c in enumerate(by_cluster)}, m[:, 0], m[:, 1], m[:, 2:]

    def score(batches):
        for rb in batches:
            gs, cs, x = rb.column("g").to_pylist(), rb.column("c").to_pylist(), _vectors(rb.column("v"))
            out = np.zeros((3, len(gs)))
            for gk in dict.fromkeys(gs):
                at = np.array([i for i, k in enumerate(gs) if k == gk])
                numbered, n, q, s = clusters[gk]
                own = np.array([numbered[cs[i]] for i in at])
                y = x[at]
                total = n * (y * y).sum(1)[:, None] - 2 * y @ s.T + q
                here = np.arange(len(at)), own
                with np.errstate(divide="ignore", invalid="ignore"):
                    a = np.where(n[own] > 1, total[here] / (n[own] - 1), np.nan)
                    mean = total / n
                    mean[here] = np.inf
                    b = mean.min(1)
                    fit = (b - a) / np.maximum(a, b)
                out[:, at] = a, b, np.where((n[own] > 1) & np.isfinite(b), fit, 0.0)
            a, b, s = (pa.array(v, mask=~np.isfinite(v)) for v in out)
            yield pa.RecordBatch.from_arrays([rb.column(id_col), rb.column("g"), a, b, s], names=[id_col, "g", "a", "b", "s"])

    doubles = [T.StructField(c, T.DoubleType()) for c in ("a", "b", "s")]
    scored = rows.mapInArrow(score, T.StructType([rows.schema[id_col], rows.schema["g"], *doubles]))
    return scored.withColumnRenamed("g", group) if group else scored.drop("g")


def nearest_centroid(points: DataFrame, id_col: str, vec: str, centres: DataFrame) -> DataFrame:
    """``id, cluster, d2``: each point's nearest centre (ties -> lowest
    id).  ``centres`` is (cluster, pos, cx); every point has the centres' length."""
    cells = {}
    for r in _matrix(centres.select("cluster", "pos", "cx"), "nearest centre"):
        cells.setdefault(r["cluster"], {})[r["pos"]] = r["cx"]
    names = sorted(cells)
    matrix = np.array([[cells[c][j] for j in range(len(cells[c]))] for c in names])
    kind = centres.schema["cluster"].dataType
    arrow = to_arrow_type(kind)

    def assign(batches):
        for rb in batches:
            x = _vectors(rb.column("v"))
            best, near = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
            for j, c in enumerate(matrix):
                d2 = ((x - c) ** 2).sum(1)
                closer = d2 < best
                best[closer], near[closer] = d2[closer], j
            yield pa.RecordBatch.from_arrays([rb.column(id_col), pa.array([names[j] for j in near] if names else [], arrow),
                                              pa.array(best)], names=[id_col, "cluster", "d2"])

    rows = points.select(id_col, F.transform(vec, lambda x: x.cast("double")).alias("v"))
    return rows.mapInArrow(assign, T.StructType([rows.schema[id_col], T.StructField("cluster", kind),
                                                 T.StructField("d2", T.DoubleType())]))


# -- moments and principal components ---------------------------------------------

def merge_moments(x: tuple, y: tuple) -> tuple:
    """Moments (n, mean, scatter matrix) of two sets of points together."""
    n = x[0] + y[0]
    if not n:
        return x
    step = y[1] - x[1]
    return n, x[1] + step * (y[0] / n), x[2] + y[2] + np.outer(step, step) * (x[0] * y[0] / n)


def moments(points: DataFrame, vec: str) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Number, mean and scatter matrix (sum of (x - mean)(x - mean)') of all
    vectors; None for no rows.

    Each task takes its points' moments about their own mean; these are merged
    in ``MERGE_WAYS`` groups of tasks and then here, so the driver sees at most
    that many matrices."""
    names = ["way", "n", "mean", "scatter"]
    ddl = "way int, n double, mean array<double>, scatter array<double>"

    def batch_of(way, m):
        return pa.RecordBatch.from_arrays([pa.array([way], pa.int32()), pa.array([float(m[0])]),
                                           pa.array([m[1].tolist()], pa.list_(pa.float64())),
                                           pa.array([m[2].ravel().tolist()], pa.list_(pa.float64()))], names=names)

    def of_row(n, mean, scatter):
        return n, np.array(mean), np.array(scatter).reshape(len(mean), -1)

    def partial(batches):
        from pyspark import TaskContext
        total = None
        for rb in batches:
            if rb.num_rows:
                x = _vectors(rb.column("v"))
                mean = x.mean(0)
                here = len(x), mean, (x - mean).T @ (x - mean)
                total = here if total is None else merge_moments(total, here)
        if total is not None:
            yield batch_of(TaskContext.get().partitionId() % MERGE_WAYS, total)

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in names[1:])))
        total = of_row(*rows[0])
        for r in rows[1:]:
            total = merge_moments(total, of_row(*r))
        return pa.Table.from_batches([batch_of(table["way"][0].as_py(), total)])

    rows = points.select(F.transform(vec, lambda x: x.cast("double")).alias("v")).mapInArrow(partial, ddl) \
        .groupBy("way").applyInArrow(merged, ddl).orderBy("way").collect()
    total = None
    for r in rows:
        here = of_row(*r[1:])
        total = here if total is None else merge_moments(total, here)
    return total


def covariance(points: DataFrame, vec: str) -> DataFrame:
    """``i, j, cov``: the sample covariance of every two components, i <= j."""
    m = moments(points, vec)
    rows = [] if m is None else [(i, j, float(m[2][i, j] / (m[0] - 1)) if m[0] > 1 else None)
                                 for i in range(len(m[1])) for j in range(i, len(m[1]))]
    return points.sparkSession.createDataFrame(rows, "i int, j int, cov double")


def pca_2d(scaled: DataFrame, id_col: str, cols) -> tuple[DataFrame, list[float]]:
    """M8: coordinates ``pca_x, pca_y`` on the two first principal components
    (sign fixed so that the largest-magnitude loading of each is positive) and
    their shares of the variance."""
    cols = list(cols)
    n, mean, scatter = moments(scaled.select(F.array(*cols).alias("v")), "v")
    size, load = np.linalg.eigh(scatter / max(n - 1, 1))
    order = np.argsort(-size, kind="stable")[:2]
    parts = []
    for j in order:
        w = load[:, j] * (1.0 if load[np.argmax(np.abs(load[:, j])), j] >= 0 else -1.0)
        term = F.lit(0.0)
        for c, m, x in zip(cols, mean, w):
            term = term + (F.col(c) - float(m)) * float(x)
        parts.append(term)
    out = scaled.select(id_col, *[p.alias(c) for p, c in zip(parts, ("pca_x", "pca_y"))])
    total = float(size.sum())
    return out, [float(size[j]) / total if total else 0.0 for j in order]


def minmax_profile(centroids: DataFrame, cols) -> DataFrame:
    """Each centroid column scaled 0..100 across clusters (equal
    bounds -> NULL).  Centroid grain (k rows)."""
    w = Window.partitionBy()
    x = centroids
    for c in cols:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        x = x.withColumn(f"{c}_norm", F.when(hi != lo, (F.col(c) - lo) / (hi - lo) * 100))
    return x
