"""Data-quality audit of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def audit_summary(wide: DataFrame, known_entities: DataFrame, ids=("entity", "category")) -> DataFrame:
    """V1-V3, V6, V7 in one pass over the wide table (plus an anti join).

    Returns one row: rows, columns, entities, periods, first/last period,
    nulls, duplicate series rows, negative cells, unmapped entities.
    """
    periods = [c for c in wide.columns if "/" in c]
    nulls = sum((F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in wide.columns), F.lit(0))
    negs = sum((F.sum((F.col(f"`{c}`") < 0).cast("long")) for c in periods), F.lit(0))
    one = wide.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("entity").alias("n_entities"),
        nulls.alias("n_nulls"),
        (F.count("*") - F.countDistinct(*ids)).alias("n_duplicates"),
        negs.alias("n_negative"))
    unmapped = (wide.select("entity").distinct()
                .join(known_entities.select("entity"), "entity", "left_anti")
                .agg(F.count("*").alias("n_unmapped")))
    return one.crossJoin(unmapped).select(
        "n_rows", F.lit(len(wide.columns)).alias("n_columns"), "n_entities",
        F.lit(len(periods)).alias("n_periods"),
        F.lit(periods[0]).alias("first_period"), F.lit(periods[-1]).alias("last_period"),
        "n_nulls", "n_duplicates", "n_negative", "n_unmapped")


def audit_raw(rows: DataFrame, table: str, key, non_negative=(), references=()) -> DataFrame:
    """V1-V3, V6, V7 on an input table as it is read: ``table, check, column,
    n`` for its rows, the nulls of every column, the rows beyond the first of
    each key (a null is a key value like others), negative values, and the
    rows whose foreign key is in no row of its table (nulls aside).

    ``references``: ``(column, other table, its column)``.  Keys are counted
    map-side first, so a key with most of the rows moves as a few counts.
    """
    key = [key] if isinstance(key, str) else list(key)

    def line(check, column, n):
        return F.struct(F.lit(table).alias("table"), F.lit(check).alias("check"),
                        F.lit(column).cast("string").alias("column"), n.alias("n"))

    one = rows.agg(F.count("*").alias("n"),
                   *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in rows.columns],
                   *[F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in non_negative])
    out = one.select(F.inline(F.array(
        line("rows", None, F.col("n")), *[line("nulls", c, F.col(f"null_{c}")) for c in rows.columns],
        *[line("negative", c, F.col(f"negative_{c}")) for c in non_negative])))

    def counted(found, check, column):
        n = F.coalesce(found["n"], F.lit(0).cast("long"))
        return found.select(F.inline(F.array(line(check, column, n))))

    repeats = rows.groupBy(*key).count().agg(F.sum(F.col("count") - 1).alias("n"))
    out = out.unionByName(counted(repeats, "duplicates", ",".join(key)))
    for column, other, other_key in references:
        used = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_fk")).count()
        lost = used.join(other.select(F.col(other_key).alias("_fk")), "_fk", "left_anti").agg(F.sum("count").alias("n"))
        out = out.unionByName(counted(lost, "unmapped", column))
    return out


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count by value, most frequent first, then by value."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def zero_entities(panel: DataFrame) -> DataFrame:
    """V5: the entities that have a zero in any period, one row each (their
    number is a count of these rows)."""
    return panel.filter(F.col("value") == 0).select("entity").distinct()


def total_consistency(computed: DataFrame, declared: DataFrame, ids=("entity", "category")) -> DataFrame:
    """V4: declared total vs sum of the periods, per series, as % of the
    declared total (zero declared -> NULL); summary: max and count > 1%."""
    j = computed.join(declared, list(ids), "inner")
    diff = F.abs(F.col("computed_total") - F.col("declared_total")) \
        / F.nullif(F.col("declared_total"), F.lit(0)) * 100
    return j.withColumn("diff_pct", diff)


def audit_report(raw: DataFrame, consistency: DataFrame, zeros: DataFrame) -> DataFrame:
    """V8: check -> value -> status, of the lines of :func:`audit_raw` for all
    input tables, the totals' consistency and the entities with zeros.  A
    largest difference below 0.01% passes."""
    n = {c: F.coalesce(F.sum(F.when(F.col("check") == c, F.col("n"))), F.lit(0)).alias(c)
         for c in ("nulls", "duplicates", "negative", "unmapped")}
    s = raw.agg(*n.values()).crossJoin(consistency).crossJoin(zeros.agg(F.count(F.lit(1)).alias("zeros")))

    def row(name, value, status):
        return F.struct(F.lit(name).alias("check"), F.col(value).cast("double").alias("value"), status.alias("status"))

    def ok_if_zero(c, bad="fail"):
        return F.when(F.col(c) == 0, "pass").otherwise(bad)

    return s.select(F.inline(F.array(
        row("nulls", "nulls", ok_if_zero("nulls")),
        row("duplicate_keys", "duplicates", ok_if_zero("duplicates")),
        row("total_max_pct_diff", "max_pct_diff", F.when(F.col("max_pct_diff") < 0.01, "pass").otherwise("review")),
        row("entities_with_zeros", "zeros", F.lit("warn")),
        row("negative_values", "negative", ok_if_zero("negative")),
        row("unmapped_keys", "unmapped", ok_if_zero("unmapped", "warn")),
    )))


def top_lists(df: DataFrame, keys: list[str], lists: list[tuple[str, str, bool, int]]) -> DataFrame:
    """Several top lists of one table in one pass: ``list int`` (its place
    in ``lists``), ``rank int`` and the ``keys``.

    A list is ``(name, column, descending, length)``; NULLs are in none, ties go
    by the keys.  A row becomes a candidate of each list, and tasks keep the
    longest list's length of them before anything moves."""
    most = max(n for *_, n in lists)
    cell = F.array(*[F.struct(F.lit(i).alias("list"), F.lit(n).alias("length"),
                              (-F.col(c) if down else F.col(c)).cast("double").alias("by"))
                     for i, (_, c, down, n) in enumerate(lists)])
    rows = df.select(*keys, F.inline(cell)).filter(F.col("by").isNotNull() & ~F.isnan("by"))
    first = Window.partitionBy("list").orderBy("by", *keys)
    return rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most) \
        .filter(F.col("rank") <= F.col("length")).select("list", "rank", *keys)
