"""Rule tables (C1-C10) as ``when`` chains; all run inside codegen.

FIXED VALUES.  The labels below are the reference's output vocabulary and
must stay equal to it (look-ups match on them):

Growth quadrants (C1): ACELERACIÓN SOSTENIDA, RECIÉN ACELERANDO,
DESACELERANDO, ESTRUCTURALMENTE DÉBILES.
Size x volatility (C2): GRANDES & VOLÁTILES, PEQUEÑOS & VOLÁTILES,
GRANDES & ESTABLES, PEQUEÑOS & ESTABLES.
Size x growth (C3): GRANDES & CRECIENDO, PEQUEÑOS & CRECIENDO,
GRANDES & ESTABLES, PEQUEÑOS & ESTABLES.
Break significance (C4): reversal, strong, moderate, mild, none.
Segment names (C5): Crisis Económica, Estancamiento, Aceleración Sostenida,
Crecimiento Maduro, Maduros Estables, Estables Predecibles; suffixes for
duplicates (C6): Severo / Leve, Lento / Rápido, (variante N).
Strategies (C7): Priorizar — alta presión, alta confianza; Vigilar — alta
presión pero forecast incierto; Asegurar — presión media, predecible;
Monitorear — presión media; Base estable — bajo riesgo de oferta; Baja
prioridad.
The texts of SEGMENT_DESCRIPTIONS (C5) and PLAYBOOKS (C9) are fixed values of
the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col_
from .ranges import quantiles

GROWTH_QUADRANTS = ("ACELERACIÓN SOSTENIDA", "RECIÉN ACELERANDO", "DESACELERANDO",
                    "ESTRUCTURALMENTE DÉBILES")
VOLATILITY_QUADRANTS = ("GRANDES & VOLÁTILES", "PEQUEÑOS & VOLÁTILES", "GRANDES & ESTABLES",
                        "PEQUEÑOS & ESTABLES")
MATRIX_QUADRANTS = ("GRANDES & CRECIENDO", "PEQUEÑOS & CRECIENDO", "GRANDES & ESTABLES",
                    "PEQUEÑOS & ESTABLES")
SEGMENT_BASE = ("Crisis Económica", "Estancamiento", "Aceleración Sostenida", "Crecimiento Maduro",
                "Maduros Estables", "Estables Predecibles")
SEGMENT_DESCRIPTIONS = {
    "Crisis Económica": "Caídas severas de consumo. Posible crisis local. Liberan oferta exportable involuntariamente.",
    "Estancamiento": "Consumo doméstico declinante leve. Mercados que pierden tracción.",
    "Aceleración Sostenida": "Crecen y la velocidad sube. Máxima señal de tensión sobre oferta.",
    "Crecimiento Maduro": "Crecen sólidamente pero el ritmo se está suavizando. Mercados consolidando.",
    "Maduros Estables": "Crecimiento bajo y consistente. Base predecible de la demanda global.",
    "Estables Predecibles": "Consumo prácticamente constante. Comportamiento muy predecible.",
}
STRATEGIES = ("Priorizar — alta presión, alta confianza",
              "Vigilar — alta presión pero forecast incierto",
              "Asegurar — presión media, predecible",
              "Monitorear — presión media",
              "Base estable — bajo riesgo de oferta",
              "Baja prioridad")
PLAYBOOKS = {
    "Aceleración Sostenida": "Asegurar abastecimiento a largo plazo. Riesgo: que el productor priorice mercado interno.",
    "Crecimiento Maduro": "Mantener relaciones. Volumen estable a corto plazo.",
    "Maduros Estables": "Aliados confiables. Buenos para contratos plurianuales.",
    "Estables Predecibles": "Base operativa. Volumen consolidado y predecible.",
    "Estancamiento Leve": "Posible oportunidad: oferta exportable creciente.",
    "Estancamiento Severo": "Oferta liberada involuntariamente. Riesgo geopolítico.",
}


def quadrant(x, y, labels, x_cut=0.0, y_cut=0.0) -> Column:
    """Two-axis quadrant: labels = (x>cut & y>cut, x<=cut & y>cut,
    x>cut & y<=cut, neither).  NULL input -> NULL."""
    xc, yc = col_(x), col_(y)
    xs = xc > (x_cut if isinstance(x_cut, Column) else F.lit(x_cut))
    ys = yc > (y_cut if isinstance(y_cut, Column) else F.lit(y_cut))
    return (F.when(xc.isNull() | yc.isNull(), F.lit(None))
            .when(xs & ys, labels[0]).when(ys, labels[1]).when(xs, labels[2]).otherwise(labels[3]))


def growth_quadrant(df: DataFrame, min_mean: float = 500_000.0) -> DataFrame:
    """Series with mean > ``min_mean`` and both half CAGRs present,
    classified by the sign of the earlier (x) and the later (y) CAGR."""
    x = df.filter((F.col("mean_value") > min_mean) & F.col("cagr_first_half").isNotNull()
                  & F.col("cagr_second_half").isNotNull())
    return x.withColumn("quadrant", quadrant("cagr_first_half", "cagr_second_half", GROWTH_QUADRANTS))


def median_quadrant(df: DataFrame, size: str, other: str, labels, min_size: float | None = None) -> DataFrame:
    """Quadrant against the medians of both columns (exact,
    interpolated), computed once as a one-row aggregate and broadcast."""
    if min_size is not None:
        df = df.filter(F.col(size) > min_size)
    med = quantiles(df, [size, other], [0.5]).select(F.col(f"_q_{size}")[0].alias("_m_size"),
                                                     F.col(f"_q_{other}")[0].alias("_m_other"))
    x = df.crossJoin(F.broadcast(med))
    return x.withColumn("quadrant", quadrant(size, other, labels, F.col("_m_size"), F.col("_m_other")))


def break_significance(pre, post, change) -> Column:
    """C4: sign flip -> reversal; > 100 strong; > 50 moderate; else mild."""
    p, q, c = col_(pre), col_(post), col_(change)
    flip = ((p > 0) & (q < 0)) | ((p < 0) & (q > 0))
    return F.when(flip, "reversal").when(c > 100, "strong").when(c > 50, "moderate").otherwise("mild")


def segment_base_name(g, a) -> Column:
    """Base segment name from centroid growth g and acceleration a."""
    g, a = col_(g), col_(a)
    return (F.when(g < -8, SEGMENT_BASE[0]).when(g < 0, SEGMENT_BASE[1]).when(a > 1.5, SEGMENT_BASE[2])
            .when(g > 2, SEGMENT_BASE[3]).when(g > 0.5, SEGMENT_BASE[4]).otherwise(SEGMENT_BASE[5]))


def name_segments(centroids: DataFrame) -> DataFrame:
    """C5 + C6: unique segment names.  Duplicated base names are ranked by
    growth ascending (cluster id breaks ties): Estancamiento -> Severo for
    rank 0 else Leve; Crecimiento Maduro -> Lento / Rápido; otherwise
    "(variante r+1)".  Centroid grain (k rows)."""
    base = centroids.withColumn("base_name", segment_base_name("growth_forecast", "acceleration"))
    w = Window.partitionBy("base_name")
    rk = F.row_number().over(w.orderBy("growth_forecast", "cluster")) - 1
    x = base.withColumn("_dup", F.count(F.lit(1)).over(w)).withColumn("_rk", rk)
    suffix = (F.when(F.col("base_name") == "Estancamiento",
                     F.when(F.col("_rk") == 0, " Severo").otherwise(" Leve"))
              .when(F.col("base_name") == "Crecimiento Maduro",
                    F.when(F.col("_rk") == 0, " Lento").otherwise(" Rápido"))
              .otherwise(F.concat(F.lit(" (variante "), (F.col("_rk") + 1).cast("string"), F.lit(")"))))
    name = F.when(F.col("_dup") > 1, F.concat("base_name", suffix)).otherwise(F.col("base_name"))
    desc = F.create_map(*[F.lit(v) for kv in SEGMENT_DESCRIPTIONS.items() for v in kv])
    return x.withColumn("cluster_name", name) \
        .withColumn("description", F.element_at(desc, F.col("base_name"))) \
        .drop("_dup", "_rk")


def strategy(ips, pred) -> Column:
    """Strategy from index and predictability (strict >).  A NULL
    predictability fails only the branches that test it."""
    i, p = col_(ips), col_(pred)
    hi_p = F.coalesce(p > 60, F.lit(False))
    lo_p = F.coalesce(p <= 60, F.lit(False))
    return (F.when((i > 60) & hi_p, STRATEGIES[0]).when((i > 60) & lo_p, STRATEGIES[1])
            .when((i > 40) & hi_p, STRATEGIES[2]).when(i > 40, STRATEGIES[3])
            .when(F.coalesce(p > 70, F.lit(False)), STRATEGIES[4]).otherwise(STRATEGIES[5]))


def strategy_parts(s) -> list[Column]:
    """Action and reason around the dash (reason NULL if no dash)."""
    parts = F.split(col_(s), "—")
    return [F.trim(parts[0]).alias("action"),
            F.when(F.size(parts) > 1, F.trim(F.element_at(parts, 2))).alias("reason")]


def playbook(name) -> Column:
    """Playbook text for a segment name, '' when absent."""
    m = F.create_map(*[F.lit(v) for kv in PLAYBOOKS.items() for v in kv])
    return F.coalesce(F.element_at(m, col_(name)), F.lit(""))


def improvement_flags(seg, lin) -> list[Column]:
    """Improvement of segmented over linear (points), its sign and the
    clipped value / flag at +-50 used for display."""
    imp = col_(lin) - col_(seg)
    return [imp.alias("improvement"), (imp > 0).alias("segmented_wins"),
            F.greatest(F.least(imp, F.lit(50.0)), F.lit(-50.0)).alias("improvement_clipped"),
            (F.abs(imp) > 50).alias("clipped")]
