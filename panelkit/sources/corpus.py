"""Text corpora as DataFrames.

S6: one row per text file (whole text), with a source label relative to a
root; files are named by paths or globs, and absent ones simply do not appear.  S7: notebook files are JSON with a
``cells`` array; the markdown and raw cells are kept in order and joined with
a blank line.  Both are plain scans + expressions, one row per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import py_strip


def _label(root: str):
    root = root.rstrip("/") + "/"
    path = F.regexp_replace(F.input_file_name(), "^file:(//)?", "")
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path)


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """Globs of the files that are there, one for every folder named in
    ``paths`` (files or globs; commas and braces are not for file names).

    A folder is asked once, whatever the number of its files; a path without a
    match is left out.  The files themselves are listed by Spark, in tasks where
    there are many."""
    folders: dict[str, list[str]] = {}
    for p in paths:
        folder, _, name = p.rpartition("/")
        folders.setdefault(folder, []).append(name)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for folder, names in folders.items():
        some = names[0] if len(names) == 1 else "{" + ",".join(dict.fromkeys(names)) + "}"
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{some}" if folder else some)
        if len(path.getFileSystem(conf).globStatus(path) or ()):
            found.append(path.toString())
    return found


def text_files(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """(source, text) for the given text files or globs, stripped."""
    globs = present(spark, paths)
    if not globs:
        return spark.createDataFrame([], "source string, text string")
    df = spark.read.text(globs, wholetext=True)
    return df.select(_label(root).alias("source"), py_strip("value").alias("text"))


def notebooks(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """(source, text) from notebook JSON: markdown/raw cells only.  A
    cell's source is a text or a list of lines, which are joined as they are."""
    globs = present(spark, paths)
    if not globs:
        return spark.createDataFrame([], "source string, text string")
    schema = "cells array<struct<cell_type:string, source:variant>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(globs)
    cells = raw.select(_label(root).alias("source"), F.posexplode("cells").alias("pos", "c"))
    lines = F.try_variant_get("c.source", "$", "array<string>")
    text = F.coalesce(F.array_join(lines, ""), F.try_variant_get("c.source", "$", "string"), F.lit(""))
    kept = cells.filter(F.col("c.cell_type").isin("markdown", "raw")).select("source", "pos", text.alias("s"))
    g = kept.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("parts"))
    return g.select("source", py_strip(F.array_join(F.col("parts.s"), "\n\n")).alias("text"))


def load_corpus(spark: SparkSession, text_paths: list[str], notebook_paths: list[str], root: str) -> DataFrame:
    return text_files(spark, text_paths, root).unionByName(notebooks(spark, notebook_paths, root))
