"""K-Means for many configurations (k, restart) at once (M5, M7).

Points are packed into leaves once: a task splits its points at medians of the
widest dimension until a leaf has at most ``LEAF`` of them, and a leaf knows its
box, mean and scatter.  Every later pass is one narrow job over the leaves whose
tasks emit partial sums only, so neither rows per configuration nor a table of
labels of all configurations ever exists:

* seeding by oversampling: in each round every restart draws ``2 * max(k)``
  points with a chance in proportion to their squared distance from those drawn
  before (smallest keys -ln(u)/d2, u a hash of point, restart and round, so the
  draw doesn't depend on partitioning).  Candidates weigh as many points as are
  nearest to them; k centres are drawn from them by weighted k-means++ on the
  driver, which sees restarts x rounds x 2k candidates and nothing of the data.
* Lloyd steps with distance bounds: a centre whose least distance to a leaf's
  box exceeds another one's greatest can't be nearest to any of its points.  A
  leaf with one centre left is added by its sum; only the others are looked
  through point by point.  Bounds are inclusive, so ties are always looked at,
  and the lowest centre wins them.
* labels are derived for the configurations that were chosen, when asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

LEAF = 64
TASK_POINTS = 1 << 16       # points a task gathers before it splits them into leaves
ROUNDS = 3                  # of oversampling


# -- leaves ---------------------------------------------------------------------

def split_points(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Rows of ``x`` as index sets of at most ``leaf``, halved at the median of
    the widest dimension."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        part = x[at]
        order = at[np.argsort(part[:, np.argmax(part.max(0) - part.min(0))], kind="stable")]
        todo += [order[:len(at) // 2], order[len(at) // 2:]]
    return out


def leaves_of(points: DataFrame, id_col: str, vec: str, seed: int) -> DataFrame:
    """``ids, hashes, points`` of every leaf; written once."""
    id_type = points.schema[id_col].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("hashes", T.ArrayType(T.LongType())),
                           T.StructField("points", T.ArrayType(T.DoubleType()))])

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        if not n:
            return
        flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        if len(flat) % n or len(set(table["v"].combine_chunks().value_lengths().to_pylist())) > 1:
            raise ValueError("vectors of one clustering must have one length")
        x = flat.reshape(n, -1)
        ids, hashes = table["id"].combine_chunks(), table["h"].combine_chunks()
        sets = split_points(x)
        order = np.concatenate(sets)
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        take = pa.array(order)
        lists = [pa.ListArray.from_arrays(pa.array(ends), c.take(take)) for c in (ids, hashes)]
        lists.append(pa.ListArray.from_arrays(pa.array(ends * x.shape[1]), pa.array(x[order].ravel())))
        yield pa.RecordBatch.from_arrays(lists, names=["ids", "hashes", "points"])

    def run(batches):
        held, rows = [], 0
        for rb in batches:
            held.append(rb)
            rows += rb.num_rows
            if rows >= TASK_POINTS:
                yield from pack(held)
                held, rows = [], 0
        if held:
            yield from pack(held)

    given = points.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"),
                          F.transform(vec, lambda v: v.cast("double")).alias("v"))
    return cut_lineage(given.mapInArrow(run, schema))


class Leaves:
    """The leaves of an Arrow batch as arrays."""

    def __init__(self, rb: pa.RecordBatch):
        lengths = rb.column("ids").value_lengths().to_numpy(zero_copy_only=False)
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        n = int(self.ends[-1])
        self.x = rb.column("points").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.hashes = rb.column("hashes").flatten().to_numpy(zero_copy_only=False)
        starts = self.ends[:-1]
        self.n = lengths.astype(np.float64)
        self.low, self.high = np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts)
        self.total = np.add.reduceat(self.x, starts)
        self.mean = self.total / self.n[:, None]
        self.leaf = np.repeat(np.arange(len(lengths)), lengths)
        self.scatter = np.bincount(self.leaf, ((self.x - self.mean[self.leaf]) ** 2).sum(1), len(lengths))

    def nearest(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centre of every leaf that has only one left (-1: several), the
        points of the other leaves, and their nearest centres."""
        below = np.stack([(np.maximum(np.maximum(self.low - c, c - self.high), 0) ** 2).sum(1) for c in centres], 1)
        above = np.stack([(np.maximum(np.abs(self.low - c), np.abs(self.high - c)) ** 2).sum(1) for c in centres], 1)
        left = below <= above.min(1, keepdims=True) * (1 + 1e-12)
        whole = np.where(left.sum(1) == 1, left.argmax(1), -1)
        at = np.flatnonzero(whole[self.leaf] < 0)
        return whole, at, squared(self.x[at], centres).argmin(1)

    def sums(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number and sum of the points nearest to each centre, and their
        squared distances from it."""
        k, d = centres.shape
        whole, at, near = self.nearest(centres)
        one = np.flatnonzero(whole >= 0)
        n = np.bincount(whole[one], self.n[one], k) + np.bincount(near, minlength=k)
        away = self.scatter[one] + self.n[one] * ((self.mean[one] - centres[whole[one]]) ** 2).sum(1)
        q = np.bincount(whole[one], away, k) + np.bincount(near, ((self.x[at] - centres[near]) ** 2).sum(1), k)
        s = np.stack([np.bincount(whole[one], self.total[one, j], k) + np.bincount(near, self.x[at, j], k)
                      for j in range(d)], 1)
        return n, s, q

    def labels(self, centres: np.ndarray) -> np.ndarray:
        whole, at, near = self.nearest(centres)
        out = whole[self.leaf]
        out[at] = near
        return out


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points x centres; 0 for equal ones."""
    return np.stack([((x - c) ** 2).sum(1) for c in centres], 1) if len(centres) else np.zeros((len(x), 0))


def uniform(hashes: np.ndarray, restart: int, turn: int) -> np.ndarray:
    """U(0,1) from a point's hash, the restart and the round."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(restart * 1009 + turn + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


# -- passes over the leaves -------------------------------------------------------

def _summed(leaves: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:meth:`Leaves.sums` of all points for every configuration: one job, each
    task emits one row per configuration, centre and figure."""
    names = ["cfg", "j", "value"]

    def run(batches):
        total = {}
        for rb in batches:
            if rb.num_rows:
                part = Leaves(rb)
                for cfg, c in centres.items():
                    n, s, q = part.sums(c)
                    row = np.concatenate([n, q, s.ravel()])
                    total[cfg] = total[cfg] + row if cfg in total else row
        for cfg, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), cfg, np.int32)),
                                              pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)], names=names)

    rows = leaves.mapInArrow(run, "cfg int, j int, value double").groupBy("cfg", "j").agg(F.sum("value").alias("value"))
    flat = {c: np.zeros(len(x) * (x.shape[1] + 2)) for c, x in centres.items()}
    for r in rows.collect():                            # configurations x k x (d + 2) numbers
        flat[r["cfg"]][r["j"]] = r["value"]
    out = {}
    for c, x in centres.items():
        k = len(x)
        out[c] = flat[c][:k], flat[c][2 * k:].reshape(x.shape), flat[c][k:2 * k]
    return out


def _drawn(leaves: DataFrame, drawn: dict[int, np.ndarray], turn: int, size: int) -> dict[int, np.ndarray]:
    """``size`` more points for every restart, far ones likelier; each task
    emits its own best ones."""
    schema = "cfg int, key double, h long, v array<double>"
    fields = pa.schema([("cfg", pa.int32()), ("key", pa.float64()), ("h", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(batches):
        best = {}
        for rb in batches:
            if not rb.num_rows:
                continue
            part = Leaves(rb)
            for cfg, before in drawn.items():
                away = squared(part.x, before).min(1) if len(before) else np.ones(len(part.x))
                with np.errstate(divide="ignore"):
                    key = np.where(away > 0, -np.log(uniform(part.hashes, cfg, turn)) / away, np.inf)
                at = np.flatnonzero(np.isfinite(key))
                at = at[np.lexsort((part.hashes[at], key[at]))[:size]]
                rows = best.get(cfg, []) + [(cfg, float(key[i]), int(part.hashes[i]), part.x[i].tolist()) for i in at]
                best[cfg] = sorted(rows)[:size]
        rows = [r for some in best.values() for r in some]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    rows = leaves.mapInArrow(run, schema)
    first = Window.partitionBy("cfg").orderBy("key", "h")
    out = {c: [*before.tolist()] for c, before in drawn.items()}
    picked = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= size).orderBy("cfg", "_r")
    for r in picked.collect():                          # restarts x size points
        if r["v"] not in out[r["cfg"]]:
            out[r["cfg"]].append(list(r["v"]))
    return {c: np.array(v, np.float64) if v else before for (c, v), before in zip(out.items(), drawn.values())}


def centres_of(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ on the candidates; where they are fewer than k, the
    last one is repeated (a repeated centre gets no points)."""
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    away = ((candidates - candidates[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        chance = weights * away
        if chance.sum() <= 0:
            chosen.append(chosen[-1])
            continue
        chosen.append(int(rng.choice(len(candidates), p=chance / chance.sum())))
        away = np.minimum(away, ((candidates - candidates[chosen[-1]]) ** 2).sum(1))
    return candidates[chosen].copy()


def seeded(leaves: DataFrame, ks, restarts: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """First centres of every (k, restart); the candidates of a restart serve
    all k."""
    size = 2 * max(ks)
    drawn = _drawn(leaves, {r: np.zeros((0, 0)) for r in range(restarts)}, 0, 1)
    if not all(len(d) for d in drawn.values()):
        raise ValueError("there are no points to cluster")
    for turn in range(1, ROUNDS + 1):
        drawn = _drawn(leaves, drawn, turn, size)
    weights = {r: n for r, (n, _, _) in _summed(leaves, drawn).items()}
    return {(k, r): centres_of(drawn[r], np.maximum(weights[r], 1e-300), k, np.random.default_rng([seed, k, r]))
            for k in ks for r in range(restarts)}


def labelled(leaves: DataFrame, centres: dict[int, np.ndarray], id_col: str) -> DataFrame:
    """``id_col, k, cluster`` for the given configurations (k -> centres)."""
    ids = leaves.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, ids), T.StructField("k", T.IntegerType()),
                           T.StructField("cluster", T.IntegerType())])

    def run(batches):
        for rb in batches:
            if rb.num_rows:
                part = Leaves(rb)
                for k, c in centres.items():
                    label = part.labels(c).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([rb.column("ids").flatten(), pa.array(np.full(len(label), k, np.int32)),
                                                      pa.array(label)], names=[id_col, "k", "cluster"])

    return leaves.mapInArrow(run, schema)


class Fit:
    """The best restart per k: ``labels`` (id, k, cluster), ``centres`` and
    ``inertia`` by k."""

    def __init__(self, leaves, id_col, centres, inertia, best):
        self.centres = {k: centres[c] for k, c in best.items()}
        self.inertia = {k: inertia[c] for k, c in best.items()}
        self.labels = labelled(leaves, self.centres, id_col)


class Runs:
    """All configurations after Lloyd's loop: how many ``steps`` it took and
    whether all centres rest (``converged``)."""

    def __init__(self, leaves, id_col, centres, inertia, steps, converged):
        self._leaves, self._id, self._centres, self._inertia = leaves, id_col, centres, inertia
        self.steps, self.converged = steps, converged

    def best(self, restarts: int | None = None) -> Fit:
        """The restart of least inertia for each k (the first one on ties),
        among all or the first ``restarts``."""
        best: dict[int, tuple[int, int]] = {}
        for k, r in sorted(self._centres):
            if (restarts is None or r < restarts) and (
                    k not in best or self._inertia[k, r] < self._inertia[best[k]] - 1e-12):
                best[k] = (k, r)
        return Fit(self._leaves, self._id, self._centres, self._inertia, best)


def kmeans(points: DataFrame, id_col: str, vec: str, ks, restarts: int, seed: int = 42,
           max_iter: int | None = None, tol: float = 1e-10) -> Runs:
    """Lloyd's algorithm for every k in ``ks`` and ``restarts`` seedings.

    A configuration whose centres move by at most ``tol`` takes no part in later
    steps; the loop ends when all rest, or after ``max_iter`` steps if that is
    given.  A centre without points stays where it is.  Vectors must have one
    length, without nulls; an empty table is an error."""
    leaves = leaves_of(points, id_col, vec, seed)
    centres = seeded(leaves, list(ks), restarts, seed)
    numbered = dict(enumerate(sorted(centres)))
    moving, steps = set(numbered), 0
    while moving and (max_iter is None or steps < max_iter):
        steps += 1
        for i, (n, s, _) in _summed(leaves, {i: centres[numbered[i]] for i in sorted(moving)}).items():
            old = centres[numbered[i]]
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], old)
            if float(np.max(np.abs(new - old))) <= tol:
                moving.discard(i)
            centres[numbered[i]] = new
    inertia = {numbered[i]: float(q.sum())
               for i, (_, _, q) in _summed(leaves, {i: centres[c] for i, c in numbered.items()}).items()}
    return Runs(leaves, id_col, centres, inertia, steps, not moving)
