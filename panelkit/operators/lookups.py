"""Name resolution and look-ups behind the question tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import broadcast_if_small
from .ranges import with_average_rank, with_position

# The reference's alias table (query name -> entity name).
ALIASES = [("vietnam", "Viet Nam"), ("ivory coast", "Côte d'Ivoire"), ("drc", "Democratic Republic of Congo"),
           ("bolivia", "Bolivia (Plurinational State of)"), ("laos", "Lao People's Democratic Republic")]


GRAM = 3            # characters of an index entry; shorter texts are found by all of their own


def _grams(c: str, n) -> Column:
    """All substrings of ``n`` characters."""
    return F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, n))


def _index(rows: DataFrame, text: str, *ids: str) -> DataFrame:
    """(ids, text, gram): the substrings of up to ``GRAM`` characters of every text."""
    sized = [F.when(F.length(text) >= n, _grams(text, n)).otherwise(F.array().cast("array<string>"))
             for n in range(1, GRAM + 1)]
    return rows.select(*ids, text, F.explode(F.array_distinct(F.concat(*sized))).alias("gram"))


def _signature(rows: DataFrame, text: str, freq: DataFrame, *ids: str) -> DataFrame:
    """(ids, text, gram): the rarest substring of every non-empty text, which
    any text that contains it has too."""
    n = F.least(F.length(text), F.lit(GRAM))
    own = rows.filter(F.length(text) > 0).select(*ids, text, F.explode(F.array_distinct(_grams(text, n))).alias("gram"))
    rarity = F.struct(F.coalesce("n", F.lit(0)), "gram")
    return own.join(freq, "gram", "left").groupBy(*ids, text).agg(F.min_by("gram", rarity).alias("gram"))


def resolve_names(names: DataFrame, entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """F8: query names (name, ord) -> entity.  Priority: exact ignoring case,
    then substring in either direction (first entity in name order), then
    the alias table.  Unresolved names get NULL.

    A text can only contain another one if it has the other one's rarest
    substring of ``GRAM`` characters, so names and entities meet by equality on
    it, either way, and only these pairs are compared.  A blank name is part of
    every entity and gets the first one.
    """
    q = names.withColumn("_q", F.lower(F.trim("name")))
    e = entities.select("entity").distinct().withColumn("_e", F.lower("entity"))
    indexed = _index(e, "_e", "entity")
    freq = indexed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    exact = q.join(e, F.col("_q") == F.col("_e")).select("ord", F.lit(1).alias("_p"), "entity")
    inside = _signature(q, "_q", freq, "ord").join(indexed, "gram").filter(F.col("_e").contains(F.col("_q")))
    around = _signature(e, "_e", freq, "entity").join(_index(q, "_q", "ord"), "gram").filter(F.col("_q").contains(F.col("_e")))
    # a blank name meets the first entity, a blank entity every name: one row each
    blank = q.filter("_q = ''").crossJoin(F.broadcast(e.agg(F.min("entity").alias("entity")))) \
        .unionByName(q.filter("_q IS NOT NULL").crossJoin(F.broadcast(e.filter("_e = ''").limit(1).select("entity"))))
    hits = exact
    for part in (inside, around, blank):
        hits = hits.unionByName(part.select("ord", F.lit(2).alias("_p"), "entity"))
    best = hits.filter("entity IS NOT NULL").groupBy("ord").agg(F.min(F.struct("_p", "entity"))["entity"].alias("entity"))
    out = q.join(best, "ord", "left")
    if aliases is not None:
        al = aliases.select(F.lower("alias").alias("_q"), F.col("entity").alias("_alias"))
        out = out.join(broadcast_if_small(al), "_q", "left") \
            .withColumn("entity", F.coalesce("entity", "_alias")).drop("_alias")
    return out.select("name", "ord", "entity")


def resolve_segment(query: str, names: DataFrame) -> DataFrame:
    """equal (ignoring case) or substring, in alphabetical order, first hit."""
    q = query.lower().strip()
    n = names.select("cluster_name").distinct()
    hit = n.filter((F.lower("cluster_name") == q) | F.lower("cluster_name").contains(q))
    return hit.orderBy("cluster_name").limit(1)


def index_rank(segments: DataFrame) -> DataFrame:
    """Average rank of ips descending, truncated to int."""
    ranked = with_average_rank(with_position(segments, [F.desc_nulls_last("ips"), "entity"]), "ips", name="_avg")
    return ranked.select(*segments.columns, F.floor("_avg").cast("int").alias("ips_rank"))


def top_n(segments: DataFrame, n: int) -> DataFrame:
    """N clamped to 1..number of entities; ties keep entity order."""
    n = max(1, int(n))
    w = Window.orderBy(F.desc("ips"), "entity")
    return segments.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def compare(segments: DataFrame, names: list[str]) -> DataFrame:
    """Metric x entity table of two to four names, in their order.
    Unknown names and other numbers of names are errors."""
    if not 2 <= len(names) <= 4:
        raise ValueError("two to four entities can be compared")
    asked = segments.sparkSession.createDataFrame([(n.strip(), i) for i, n in enumerate(names)],
                                                  "name string, ord int")
    found = resolve_names(asked, segments.select("entity")).orderBy("ord").collect()      # at most four names
    if unknown := [r["name"] for r in found if r["entity"] is None]:
        raise ValueError(f"no such entity: {', '.join(unknown)}")
    entities = [r["entity"] for r in found]
    metrics = [("region", F.col("region")), ("cluster_name", F.col("cluster_name")),
               ("share_global_pct", F.format_string("%.2f%%", "share_global_pct")),
               ("growth_forecast", F.format_string("%+.2f%%", "growth_forecast")),
               ("acceleration", F.format_string("%+.2f pp", "acceleration")),
               ("predictability", F.format_string("%.0f/100", "predictability")),
               ("ips", F.format_string("%.1f", "ips"))]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("metric"), v.alias("shown"))
                      for i, (m, v) in enumerate(metrics)])
    long = segments.filter(F.col("entity").isin(entities)).select("entity", F.inline(cells))
    return long.groupBy("i", "metric").pivot("entity", entities).agg(F.first("shown")).orderBy("i").drop("i")
