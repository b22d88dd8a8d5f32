"""Queries of the question stage: chunks, vectors, look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r2, r6, rnd
from ..operators import lookups as LK
from ..operators import retrieval as RT
from ..operators.joins import literal_table
from ..operators.ranges import with_position
from ..session import cut_lineage
from ..sources.tables import read_table
from .catalog import register
from .panels import panel_a
from .q_segment import SEG_SQL
from .segments import register_both
from .sqlparts import with_panel

# RE2 spelling of the same white-space class as retrieval.WS
WS_RE2 = ("[\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
          "\\x{202F}\\x{205F}\\x{3000}]")
STRIP = "regexp_replace(@X@, '^" + WS_RE2 + "+|" + WS_RE2 + "+$', '', 'g')"


def _strip_sql(x):
    return STRIP.replace("@X@", x)


CHUNKS_SQL = f"""WITH d AS (SELECT doc_id, source, {_strip_sql('text')} AS t FROM documents),
d2 AS (SELECT doc_id, source, t, length(t) AS L FROM d WHERE length(t) > 0),
w AS (SELECT doc_id, source, t, unnest(range(0, CAST(greatest(0, ceil((L - 1100) / 950)) AS BIGINT) + 1)) AS k FROM d2),
c AS (SELECT doc_id, source, k, {_strip_sql('substring(t, CAST(k * 950 + 1 AS BIGINT), 1100)')} AS text FROM w),
ck AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_id, text
       FROM c WHERE length(text) > 0)"""


@register("doc_chunks", CHUNKS_SQL + """
SELECT doc_id, source, chunk_id, text FROM ck""")
def q_doc_chunks(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "source", "text")
    return RT.chunk_corpus(docs)


@register("chunk_stats", CHUNKS_SQL + """
SELECT source, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(max(length(text)) AS INTEGER) AS max_len
FROM ck GROUP BY 1""")
def q_chunk_stats(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "source", "text")
    ch = RT.chunk_corpus(docs)
    return ch.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).cast("long").alias("n_chars"),
                                    F.max(F.length("text")).alias("max_len"))


NORM_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v),
u AS (SELECT vec_id, norm, CASE WHEN norm > 0 THEN list_transform(e, lambda x: x / norm) ELSE e END AS u FROM n)"""


@register("embedding_norms", NORM_SQL + """
SELECT vec_id, round(norm, 6) AS norm, list_transform(u, lambda x: round(x, 6)) AS unit FROM u""")
def q_embedding_norms(spark, sf):
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding")
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return e.select("vec_id", r6(norm).alias("norm"),
                    F.transform(RT.l2_normalise("embedding"), lambda x: rnd(x, 6)).alias("unit"))


# Every row whose id is divisible by QUERY_EVERY is a query, against all rows.
QUERY_EVERY = 20
TOPK_SQL = NORM_SQL + f""",
ex AS (SELECT vec_id, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM u),
sc AS (SELECT q.vec_id AS query, c.vec_id AS doc, sum(q.x * c.x) AS score
       FROM ex q JOIN ex c ON q.pos = c.pos WHERE q.vec_id % {QUERY_EVERY} = 0 GROUP BY 1, 2),
rk AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc)"""


@register("snippets", CHUNKS_SQL + f""",
cv AS (SELECT doc_id, source, chunk_id,
              regexp_replace({_strip_sql('text')}, '{WS_RE2}+', ' ', 'g') AS s FROM ck)
SELECT doc_id, source, chunk_id,
       CASE WHEN length(s) > 420 THEN regexp_replace(substring(s, 1, 420), '{WS_RE2}+$', '', 'g') || '...'
            ELSE s END AS snippet
FROM cv""")
def q_snippets(spark, sf):
    """Snippet of every chunk (the text a hit shows)."""
    docs = read_table(spark, sf, "documents", "doc_id", "source", "text")
    ch = RT.chunk_corpus(docs)
    return ch.select("doc_id", "source", "chunk_id", RT.snippet("text").alias("snippet"))



def _search_all(spark, sf):
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding")
    return RT.cosine_topk(e, e.filter(F.col("vec_id") % QUERY_EVERY == 0), k=RT.TOP_K)


@register("cosine_topk_all", TOPK_SQL + """
SELECT query, CAST(rank AS INTEGER) AS rank, doc AS vec_id, round(score, 6) AS score FROM rk WHERE rank <= 4""")
def q_cosine_topk_all(spark, sf):
    return _search_all(spark, sf).select("query", F.col("rank").cast("int").alias("rank"), "vec_id", r6("score").alias("score"))


@register("hit_snippets_all", TOPK_SQL + ",\n" + CHUNKS_SQL.removeprefix("WITH ") + f""",
cv AS (SELECT doc_id, source, chunk_id,
              regexp_replace({_strip_sql('text')}, '{WS_RE2}+', ' ', 'g') AS s FROM ck)
SELECT rk.query, CAST(rk.rank AS INTEGER) AS rank, rk.doc AS vec_id, round(rk.score, 6) AS score, cv.source, cv.chunk_id,
       CASE WHEN length(s) > 420 THEN regexp_replace(substring(s, 1, 420), '{WS_RE2}+$', '', 'g') || '...'
            ELSE s END AS snippet
FROM rk LEFT JOIN cv ON cv.doc_id = rk.doc WHERE rk.rank <= 4""")
def q_hit_snippets_all(spark, sf):
    """What the whole search shows: every passage of every document hit, one
    row per hit and chunk.  The hits are written once, as they are read twice."""
    hits = cut_lineage(_search_all(spark, sf))
    docs = read_table(spark, sf, "documents", "doc_id", "source", "text")
    hit_docs = docs.join(hits.select(F.col("vec_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    shown = RT.chunk_corpus(hit_docs).select(
        F.col("doc_id").alias("vec_id"), "source", "chunk_id", RT.snippet("text").alias("snippet"))
    return hits.join(shown, "vec_id", "left").select(
        "query", F.col("rank").cast("int").alias("rank"), "vec_id", r6("score").alias("score"), "source", "chunk_id", "snippet")


PROBE = [("NATION_3", 1), ("nation_12", 2), ("TION_2", 3), ("vietnam", 4), ("atlantis", 5)]


@register("resolve_entity", """WITH names(name, ord) AS (VALUES """
          + ", ".join(f"('{n}', {i})" for n, i in PROBE) + """),
ents AS (SELECT DISTINCT n_name AS entity FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey
         JOIN orders o ON o.o_custkey = c.c_custkey),
al(alias, entity) AS (VALUES """ + ", ".join("('{}', '{}')".format(a, e.replace("'", "''")) for a, e in LK.ALIASES)
          + """),
m AS (SELECT q.ord, e.entity, CASE WHEN lower(trim(q.name)) = lower(e.entity) THEN 1
                                   WHEN contains(lower(e.entity), lower(trim(q.name)))
                                     OR contains(lower(trim(q.name)), lower(e.entity)) THEN 2 END AS p
      FROM names q, ents e),
best AS (SELECT ord, entity FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY p, entity) AS r
                                  FROM m WHERE p IS NOT NULL) WHERE r = 1)
SELECT q.name, CAST(q.ord AS INTEGER) AS ord, coalesce(b.entity, a.entity) AS entity
FROM names q LEFT JOIN best b ON b.ord = q.ord LEFT JOIN al a ON a.alias = lower(trim(q.name))""")
def q_resolve_entity(spark, sf):
    names = literal_table(spark, PROBE, "name string, ord int")
    ents = panel_a(spark, sf).select("entity").distinct()
    al = literal_table(spark, LK.ALIASES, "alias string, entity string")
    return LK.resolve_names(names, ents, al)


@register_both("resolve_segment", with_panel(SEG_SQL + """
SELECT cluster_name FROM rcent WHERE contains(lower(cluster_name), 'aceleración') OR lower(cluster_name) = 'aceleración'
ORDER BY cluster_name LIMIT 1""", recursive=True))
def q_resolve_segment(seg):
    return LK.resolve_segment("aceleración", seg.rows)


@register_both("entity_profile", with_panel(SEG_SQL + """,
lastv AS (SELECT entity, sum(value) AS v FROM panel WHERE t = (SELECT max(t) FROM panel) GROUP BY 1),
ranked AS (SELECT *, CAST(floor(rank() OVER (ORDER BY ips DESC) + (count(*) OVER (PARTITION BY ips) - 1) / 2.0) AS INTEGER)
                       AS ips_rank FROM segs)
SELECT r.entity, region, cluster_name, round(v / 1e6, 2) AS last_m, round(share_global_pct, 2) AS share_global_pct,
       round(growth_forecast, 2) AS growth_forecast, round(acceleration, 2) AS acceleration,
       round(growth_historical, 2) AS growth_historical, round(predictability, 0) AS predictability,
       round(ips, 1) AS ips, ips_rank, strategy
FROM ranked r LEFT JOIN lastv l ON l.entity = r.entity WHERE r.entity = 'NATION_7'""", recursive=True))
def q_entity_profile(seg):
    """Profile of one entity (resolved name), last-period value and index rank."""
    ranked = LK.index_rank(seg.rows)
    names = literal_table(ranked.sparkSession, [("nation_7", 1)], "name string, ord int")
    hit = LK.resolve_names(names, ranked.select("entity")).select("entity")
    last = seg.panel.join(F.broadcast(seg.panel.agg(F.max("t").alias("t"))), "t") \
        .groupBy("entity").agg(F.sum("value").alias("last_value"))
    p = ranked.join(hit, "entity").join(last, "entity", "left")
    return p.select("entity", "region", "cluster_name", r2(F.col("last_value") / 1e6).alias("last_m"),
                    r2("share_global_pct").alias("share_global_pct"), r2("growth_forecast").alias("growth_forecast"),
                    r2("acceleration").alias("acceleration"), r2("growth_historical").alias("growth_historical"),
                    rnd("predictability", 0).alias("predictability"), rnd("ips", 1).alias("ips"),
                    "ips_rank", "strategy")


@register_both("top_n_index", with_panel(SEG_SQL + """
SELECT CAST(row_number() OVER (ORDER BY ips DESC, entity) AS INTEGER) AS position, entity, region, cluster_name,
       round(ips, 1) AS ips, round(share_global_pct, 1) AS share_global_pct, round(growth_forecast, 1) AS growth_forecast
FROM segs QUALIFY position <= 10""", recursive=True))
def q_top_n_index(seg):
    s = LK.top_n(seg.rows, 10)
    return s.select("position", "entity", "region", "cluster_name", rnd("ips", 1).alias("ips"),
                    rnd("share_global_pct", 1).alias("share_global_pct"),
                    rnd("growth_forecast", 1).alias("growth_forecast"))


@register_both("segment_card", with_panel(SEG_SQL + """
SELECT c.cluster_name, round(c.growth_forecast, 2) AS growth_forecast, round(c.acceleration, 2) AS acceleration,
       round(c.cv, 2) AS cv, round(c.predictability, 2) AS predictability, c.n_entities AS n_members,
       row_number() OVER (PARTITION BY s.cluster_name ORDER BY s.ips DESC, s.entity) AS position, s.entity
FROM rcent c JOIN segs s ON s.cluster_name = c.cluster_name""", recursive=True))
def q_segment_card(seg):
    """Centroid and member count with the members by index (descending),
    one row per member."""
    members = with_position(seg.rows.select("cluster_name", "ips", "entity"), [F.desc("ips"), "entity"],
                            ["cluster_name"])
    c = seg.centroids.select("cluster_name", F.col("n_entities").cast("long").alias("n_members"), *[
        r2(x).alias(x) for x in ("growth_forecast", "acceleration", "cv", "predictability")])
    return members.join(c, "cluster_name").select(*c.columns, F.col("pos").cast("long").alias("position"), "entity")


COMPARED = ["NATION_1", "nation_3", "NATION_5"]
METRIC_SQL = [("region", "region"), ("cluster_name", "cluster_name"),
              ("share_global_pct", "printf('%.2f%%', share_global_pct)"),
              ("growth_forecast", "printf('%+.2f%%', growth_forecast)"),
              ("acceleration", "printf('%+.2f pp', acceleration)"),
              ("predictability", "printf('%.0f/100', predictability)"), ("ips", "printf('%.1f', ips)")]


@register_both("compare_entities", with_panel(SEG_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, " + ", ".join(f"max({v}) FILTER (WHERE entity = '{n.upper()}') AS {n.upper()}"
                                            for n in COMPARED) + " FROM segs" for m, v in METRIC_SQL), recursive=True))
def q_compare_entities(seg):
    """Metric x entity table for 2..4 resolved names (in the given
    order); unknown names and other numbers of names are errors."""
    return LK.compare(seg.rows, COMPARED)


@register_both("top5_cards", with_panel(SEG_SQL + """
SELECT CAST(row_number() OVER (ORDER BY ips DESC, entity) AS INTEGER) AS position, entity, cluster_name,
       round(ips, 1) AS ips, round(growth_forecast, 2) AS growth_forecast, round(share_global_pct, 2) AS share_global_pct,
       round(predictability, 0) AS predictability, strategy
FROM segs QUALIFY position <= 5""", recursive=True))
def q_top5_cards(seg):
    """Five metrics for the five entities with the highest index."""
    s = LK.top_n(seg.rows, 5)
    return s.select("position", "entity", "cluster_name", rnd("ips", 1).alias("ips"),
                    rnd("growth_forecast", 2).alias("growth_forecast"),
                    rnd("share_global_pct", 2).alias("share_global_pct"),
                    rnd("predictability", 0).alias("predictability"), "strategy")
