"""K-Means, silhouette, nearest centres and PCA: invariants and brute force."""

import itertools

import numpy as np
import pytest

from panelkit.operators import cluster as CL
from panelkit.operators import kmeans as KM


def _frame(spark, x, id_type="long"):
    rows = [(i if id_type == "long" else f"e{i}", [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, f"id {id_type}, v array<double>")


def _points(seed, n=900, d=3, groups=5):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (n, d)) + rng.normal(0, 6, (groups, d))[rng.integers(0, groups, n)]


def test_leaves_hold_every_point_once_and_bounds_skip_most():
    x = _points(1, 5000, 2)
    sets = KM.split_points(x)
    assert sorted(np.concatenate(sets).tolist()) == list(range(5000)) and max(map(len, sets)) <= KM.LEAF


@pytest.mark.parametrize("grid", [False, True])
def test_fit_is_a_resting_point(spark, grid):
    """Every point has its nearest centre, every centre is its points' mean,
    and inertia is the sum of squared distances."""
    x = np.round(_points(2)) if grid else _points(2)        # on a grid: ties and repeated points
    pts = _frame(spark, x, "string").repartition(5)
    runs = KM.kmeans(pts, "id", "v", (2, 5), 3, seed=7)
    assert runs.converged and runs.steps >= 1
    fit = runs.best()
    for k in (2, 5):
        label = np.zeros(len(x), int)
        got = fit.labels.filter(f"k = {k}").collect()
        assert len(got) == len(x)
        for r in got:
            label[int(r["id"][1:])] = r["cluster"]
        c = fit.centres[k]
        d2 = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (label == d2.argmin(1)).all()
        for j in range(k):
            assert np.allclose(c[j], x[label == j].mean(0), atol=1e-9)
        assert np.isclose(fit.inertia[k], d2.min(1).sum())


def test_partitions_do_not_change_the_seeding(spark):
    x = _points(3)
    fits = [KM.kmeans(_frame(spark, x).repartition(n), "id", "v", (4,), 2).best() for n in (1, 6)]
    assert np.allclose(fits[0].centres[4], fits[1].centres[4])


def test_inertia_is_not_above_brute_force(spark):
    """The best of 20 restarts against the optimum of all partitions of 9
    points, and against plain Lloyd runs on a larger set."""
    x = np.random.default_rng(4).normal(size=(9, 2))
    best = min(sum(((x[np.array(a) == j] - x[np.array(a) == j].mean(0)) ** 2).sum() for j in set(a))
               for a in itertools.product(range(3), repeat=9))
    assert np.isclose(KM.kmeans(_frame(spark, x), "id", "v", (3,), 20).best().inertia[3], best)
    y = _points(5, 600, 2, 6)
    rng, plain = np.random.default_rng(0), np.inf
    for _ in range(20):
        c = y[rng.choice(len(y), 6, replace=False)]
        for _ in range(100):
            at = ((y[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([y[at == j].mean(0) if (at == j).any() else c[j] for j in range(6)])
        plain = min(plain, ((y[:, None] - c[None]) ** 2).sum(2).min(1).sum())
    # both end in local optima of the same valley: a part in a thousand is left open
    assert KM.kmeans(_frame(spark, y), "id", "v", (6,), 20).best().inertia[6] <= plain * 1.001


def test_few_distinct_points_and_no_steps(spark):
    pts = spark.createDataFrame([(i, [float(i % 3) * 10, float(i % 2)]) for i in range(30)], "id int, v array<double>")
    free, cut = KM.kmeans(pts, "id", "v", (3, 8), 4), KM.kmeans(pts, "id", "v", (3,), 4, max_iter=0)
    assert free.converged and free.steps >= 1 and not cut.converged and cut.steps == 0
    assert free.best(2).labels.count() == 60 and free.best().inertia[8] == 0       # six distinct points
    assert free.best().inertia[3] <= free.best(2).inertia[3]
    with pytest.raises(ValueError):
        KM.kmeans(pts.limit(0), "id", "v", (3,), 1)


def test_silhouette_against_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)) + 3
    label = {2: rng.integers(0, 2, 60), 5: np.r_[rng.integers(0, 4, 59), 4]}         # 4: a singleton
    labels = spark.createDataFrame([(i, k, int(c)) for k, cs in label.items() for i, c in enumerate(cs)], "id long, k int, cluster int")
    got = {(r["k"], r["id"]): r["s"] for r in CL.silhouette_sq(_frame(spark, x), "id", "v", labels, group="k").collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    for k, cs in label.items():
        for i in range(60):
            own = (cs == cs[i]) & (np.arange(60) != i)
            b = min(d2[i, cs == c].mean() for c in set(cs) - {cs[i]})
            want = (b - d2[i, own].mean()) / max(b, d2[i, own].mean()) if own.any() else 0.0
            assert np.isclose(got[k, i], want), (k, i)
    alone = spark.createDataFrame([(i, 1) for i in range(60)], "id long, cluster int")
    assert {r["s"] for r in CL.silhouette_sq(_frame(spark, x), "id", "v", alone).collect()} == {0.0}


def test_nearest_centre_takes_the_lowest_of_ties(spark):
    x = [[0.0, 0.0], [4.0, 0.0], [2.0, 1.0]]
    centres = spark.createDataFrame([(c, j, v) for c, row in ((7, [4.0, 0.0]), (3, [0.0, 0.0])) for j, v in enumerate(row)],
                                    "cluster int, pos int, cx double")
    got = {r["id"]: (r["cluster"], r["d2"]) for r in CL.nearest_centroid(_frame(spark, x), "id", "v", centres).collect()}
    assert got == {0: (3, 0.0), 1: (7, 0.0), 2: (3, 5.0)}


def test_matrix_sizes_are_checked(spark, monkeypatch):
    monkeypatch.setattr(CL, "MAX_MATRIX", 3)
    centres = spark.createDataFrame([(c, j, 0.0) for c in range(2) for j in range(2)], "cluster int, pos int, cx double")
    with pytest.raises(ValueError):
        CL.nearest_centroid(_frame(spark, [[0.0, 0.0]]), "id", "v", centres)


def test_moments_merge_and_components(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 3)) + [1e6, -5, 0]
    parts = [x[:1], x[1:40], x[40:]]
    total = None
    for p in parts:
        m = len(p), p.mean(0), (p - p.mean(0)).T @ (p - p.mean(0))
        total = m if total is None else CL.merge_moments(total, m)
    assert np.allclose(total[2] / 499, np.cov(x.T)) and np.allclose(total[1], x.mean(0))
    n, mean, scatter = CL.moments(_frame(spark, x).repartition(40), "v")
    assert n == 500 and np.allclose(mean, x.mean(0)) and np.allclose(scatter / 499, np.cov(x.T))
    assert CL.moments(_frame(spark, x).limit(0), "v") is None
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, a double, b double, c double")
    out, share = CL.pca_2d(df, "id", ["a", "b", "c"])
    size, load = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(share, size[::-1][:2] / size.sum())
    got = np.array([[r["pca_x"], r["pca_y"]] for r in out.orderBy("id").collect()])
    for j in range(2):
        w = load[:, 2 - j]
        w = w if w[np.abs(w).argmax()] > 0 else -w
        assert np.allclose(got[:, j], (x - x.mean(0)) @ w, atol=1e-6)
    assert np.allclose(got.var(0, ddof=1), size[::-1][:2])
