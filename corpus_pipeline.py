"""Pipeline of a training corpus: score and filter, drop exact copies, keep one
of each near-duplicate group, replace personal data, pack into sequences.

Every stage reads the table its predecessor wrote and calls one operator of
``panelkit.llm``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelkit.llm import exact_dedup, packing, pii, quality_cnn, simhash
from panelkit.llm.queries import tokenizer_path
from panelkit.session import checkpoint_dir
from panelkit.sources.tables import read_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (predicted 1).

    The score depends on the text alone; labels are learned from as in the
    operator's contract.  The network runs beside the columns it filters, so
    rows are neither moved nor joined.
    """
    model = quality_cnn.train(docs, read_table(spark, sf_dir, "labels"))
    return quality_cnn.accepted(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (the largest doc_id)."""
    return exact_dedup.keep_one(docs, exact_dedup.exact_dedup(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one its component is named by,
    and where no member has a doc_id the one with the least hash."""
    return simhash.keep_one(docs, simhash.SHINGLE_WORDS, simhash.MAX_BITS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms of the same format."""
    return pii.pseudonymise_column(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of the remaining documents."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality_filter), ("exact_dedup", exact_copies), ("simhash", near_copies),
          ("pii", personal_data), ("packing", pack)]

#: SQL can express neither the network nor the tokenizer.
ORACLE_SQL = None


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to and read from
    the shared folder; a table goes when the next one is written (the last one
    stays, as the result may still read it)."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _drop(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
