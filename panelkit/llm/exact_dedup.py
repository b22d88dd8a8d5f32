"""Exact dedup by deterministic block naming (operator 2).

A text (A-Z lower-cased, as UTF-8) is cut into blocks of a fixed size.  Blocks
are sorted into integer names; then names of adjacent pairs are sorted into
names of the next level, and so on until one name is left.  Equal texts have
equal names at every level, different texts differ at the last: the level and
name are a collision-free identity, as values themselves are compared and
never a digest of them.

Contents are shuffled once (level 0); every later level moves integers, half
as many each time, and is kept in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, doc_columns
from .naming import with_names

BLOCK_BYTES = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id inside the operator, so that keys join.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per row: its key (``k``: doc_id, ``h``: a hash of the text, which only
    tells apart texts that share a doc_id) and normalised ``body``."""
    body = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER).cast("binary")
    return (docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), body.alias("body"))
            .withColumn("h", F.xxhash64("body")))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``k, h, level, name``: the identity of every distinct key."""
    at = F.expr(f"explode(transform(sequence(0, greatest(0, int((octet_length(body) - 1) div {block_bytes}))), "
                f"i -> struct(i as pos, substring(body, i * {block_bytes} + 1, {block_bytes}) as block)))")
    blocks = keyed(docs).select("k", "h", at.alias("b")).select("k", "h", F.col("b.pos").alias("pos"),
                                                                F.col("b.block").alias("block"))
    names = cut_lineage(with_names(blocks, ["block"]))
    done, level = None, 0
    while True:
        # a key is done when position 0 is all it has
        more = names.filter(F.col("pos") == 1).select("k", "h").distinct()
        single = (names.filter(F.col("pos") == 0).join(more, ["k", "h"], "left_anti")
                  .select("k", "h", F.lit(level).alias("level"), "name").distinct())
        done = single if done is None else done.unionByName(single)
        going = names.join(more, ["k", "h"], "left_semi")
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = cut_lineage(going.groupBy("k", "h", F.expr("pos div 2").cast("int").alias("pos"))
                            .agg(side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right")))
        if pairs.isEmpty():
            return done
        names = cut_lineage(with_names(pairs, ["left", "right"]))
        level += 1


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size long, kept
    boolean, text_sha256``.

    Null text counts as empty; texts are equal when identical after
    lower-casing A-Z.  Of equal texts the largest doc_id stays; of repeated
    rows with that doc_id one stays; a null doc_id stays only if its group has
    no other.  An empty table gives no rows; other columns are ignored.
    """
    ids = identities(docs, block_bytes)
    rows = (keyed(docs).groupBy("k", "h", F.sha2("body", 256).alias("text_sha256")).agg(F.count("*").alias("copies")))
    rows = cut_lineage(rows.join(ids, ["k", "h"]))
    real = F.when(F.col("k") != NO_ID, F.col("k"))
    groups = cut_lineage(rows.groupBy("level", "name").agg(F.max(real).alias("keep_id"),
                                                           F.sum("copies").alias("group_size")))
    return (rows.join(groups, ["level", "name"])
            .select(real.alias("doc_id"), "keep_id", "group_size", "text_sha256",
                    F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def keep_one(docs: DataFrame, result: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all columns."""
    keys = result.filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__k"), F.col("text_sha256").alias("__s"))
    body = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    marked = docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
                               "__s": F.sha2(body.cast("binary"), 256)})
    return (marked.join(keys, ["__k", "__s"], "left_semi").dropDuplicates(["__k", "__s"]).select(*docs.columns))
