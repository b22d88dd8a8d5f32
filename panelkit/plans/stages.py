"""Stage outputs shared by the queries of one build.

The reference chains its stages through files; here each stage output is
cut from its lineage with a reliable checkpoint (in the shared folder named
by ``spark.checkpoint.dir``) the first time a query needs it, so that later
operators plan against a short scan instead of re-deriving the panel, the
breaks and the backtest inside one ever-growing plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import backtest as BT
from ..operators import breaks as BK
from ..operators import forecast as FC
from ..session import cut_lineage
from .panels import panel_a

KEYS = ["entity", "category"]


class Stages:
    def __init__(self, spark: SparkSession, sf_dir: str, panel_fn=panel_a, keys=KEYS):
        self.spark, self.sf, self.keys = spark, sf_dir, list(keys)
        self._panel_fn = panel_fn
        self._memo: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._memo:
            self._memo[name] = cut_lineage(build())
        return self._memo[name]

    @property
    def panel(self) -> DataFrame:
        """The panel, checkpointed once.  A checkpoint is read back without
        its partitioning, so later per-series steps exchange it again (series
        rows only, after map-side aggregation of the facts)."""
        def build():
            # by column only: AQE may still coalesce or split the partitions
            return self._panel_fn(self.spark, self.sf).repartition(*self.keys)
        return self._get("panel", build)

    @property
    def breaks(self) -> DataFrame:
        return self._get("breaks", lambda: BK.detect_breaks(self.panel, self.keys))

    @property
    def scores(self) -> DataFrame:
        return self._get("scores", lambda: BT.backtest_scores(self.panel, self.breaks, self.keys))

    @property
    def summary(self) -> DataFrame:
        def build():
            from pyspark.sql import functions as F
            from ..operators import models as MD
            sc = self.scores
            wide = sc.groupBy(*self.keys).pivot("model", list(MD.MODEL_ORDER)).agg(F.first("mape"))
            for m in MD.MODEL_ORDER:
                wide = wide.withColumnRenamed(m, f"{m}_mape")
            return wide.join(BT.best_model(sc, self.keys), self.keys, "left")
        return self._get("summary", build)

    @property
    def forecasts(self) -> DataFrame:
        return self._get("forecasts", lambda: FC.forecast_all(self.panel, self.breaks, self.summary, self.keys))


class SegmentStages(Stages):
    """Stage 3: features -> winsorise -> robust scale -> K-Means (k chosen by
    silhouette) -> PCA -> centroids -> names -> index -> strategy."""

    K_RANGE = (4, 5, 6, 7)       # fixed values of the reference
    RESTARTS_SELECT = 20
    RESTARTS_FINAL = 50
    SEED = 42

    @property
    def features(self) -> DataFrame:
        from ..operators import features as FT
        return self._get("features", lambda: FT.entity_features(self.panel, self.breaks, self.summary,
                                                                self.forecasts))

    @property
    def eligible(self) -> DataFrame:
        """Entities with every clustering feature; the others are listed by
        :meth:`left_out`."""
        from ..operators import features as FT
        return self.features.dropna(subset=FT.CLUSTER_FEATURES)

    def left_out(self) -> DataFrame:
        """Entities that can't be segmented, with the features they lack."""
        from pyspark.sql import functions as F
        from ..operators import features as FT
        missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in FT.CLUSTER_FEATURES]))
        return self.features.select("entity", "region", F.array_join(missing, ",").alias("missing")) \
            .filter(F.col("missing") != "")

    @property
    def scored(self) -> DataFrame:
        """Index and strategy of the eligible entities; needs no clusters."""
        from ..operators import score as SC
        return self._get("scored", lambda: SC.with_strategy(SC.pressure_index(self.eligible)))

    def _cluster(self):
        if "segments" in self._memo:
            return
        from pyspark.sql import functions as F
        from ..operators import cluster as CL
        from ..operators import features as FT
        from ..operators import kmeans as KM
        from ..operators import rules as RU
        cols = FT.CLUSTER_FEATURES
        base = self.eligible
        w = FT.winsorize(base, cols)
        scaled, params = FT.robust_scale(w, cols)
        scaled = cut_lineage(scaled.withColumn("vec", F.array(*[F.col(f"z_{c}") for c in cols])))
        # One Lloyd loop serves both fits: restarts 0..19 of every k select k
        # by silhouette, restarts 0..49 of the chosen k give the final model.
        runs = KM.kmeans(scaled, "entity", "vec", self.K_RANGE, self.RESTARTS_FINAL, self.SEED)
        labels = runs.best(self.RESTARTS_SELECT).labels
        sil = CL.silhouette_sq(scaled, "entity", "vec", labels, group="k").groupBy("k").agg(F.avg("s").alias("sil"))
        sil_rows = sorted((r["k"], r["sil"]) for r in sil.collect())
        best_k = max(sil_rows, key=lambda kv: (kv[1], -kv[0]))[0]
        final = runs.best()
        lab = final.labels.filter(F.col("k") == best_k)
        centres = final.centres
        # centroids in original units, relabelled by growth descending
        p = params.first()
        rows = []
        for c, vec in enumerate(centres[best_k]):
            orig = [float(vec[j]) * p[f"iqr_{col}"] + p[f"med_{col}"] for j, col in enumerate(cols)]
            rows.append((c, *orig))
        order = sorted(rows, key=lambda r: (-r[1], r[0]))
        relabel = {r[0]: i for i, r in enumerate(order)}
        spark = self.spark
        cent = spark.createDataFrame([(relabel[r[0]], *r[1:]) for r in rows],
                                     "cluster int, " + ", ".join(f"{c} double" for c in cols))
        mp = F.create_map(*[F.lit(x) for kv in relabel.items() for x in kv])
        lab = lab.select("entity", F.element_at(mp, F.col("cluster")).cast("int").alias("cluster"))
        counts = lab.groupBy("cluster").agg(F.count("*").cast("int").alias("n_entities"))
        cent = RU.name_segments(cent.join(counts, "cluster", "left").fillna(0, ["n_entities"]))
        coords, ev = CL.pca_2d(scaled, "entity", [f"z_{c}" for c in cols])
        seg = self.scored.join(lab, "entity").join(coords, "entity") \
            .join(cent.select("cluster", "cluster_name"), "cluster")
        self._memo["centroids"] = cut_lineage(cent)
        self._memo["segments"] = cut_lineage(seg)
        self._memo["scaled"] = scaled
        self.meta = {"best_k": best_k, "steps": runs.steps, "converged": runs.converged, "silhouette": dict(sil_rows),
                     "explained_variance": ev}

    @property
    def segments(self) -> DataFrame:
        self._cluster()
        return self._memo["segments"]

    @property
    def centroids(self) -> DataFrame:
        self._cluster()
        return self._memo["centroids"]


_CACHE: dict = {}


def stages_for(spark: SparkSession, sf_dir: str) -> SegmentStages:
    """Stage outputs shared by all queries of one session and data folder
    (the checkpointed tables play the role of the reference's stage files)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = SegmentStages(spark, sf_dir)
    return _CACHE[key]


def clear_stage_cache() -> None:
    _CACHE.clear()


def user_stages_for(spark: SparkSession, sf_dir: str) -> Stages:
    """Stages over Panel B (user x day): the series count grows with the data."""
    from .panels import panel_b
    key = (spark.sparkContext.applicationId, sf_dir, "b")
    if key not in _CACHE:
        _CACHE[key] = Stages(spark, sf_dir, panel_fn=panel_b)
    return _CACHE[key]
