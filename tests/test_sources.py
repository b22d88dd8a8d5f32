"""Corpus readers and sinks on synthetic files in a fresh temp folder."""

import json
import os
import tempfile

from panelkit.operators.retrieval import chunk_corpus
from panelkit.sources.corpus import load_corpus, present, text_files
from panelkit.sources.sinks import read_json, write_json, write_parquet


def test_corpus_and_notebook(spark):
    root = tempfile.mkdtemp(prefix="panelkit-corpus-")
    with open(f"{root}/readme.md", "w") as f:
        f.write("  Title\n\nSome text.  \n")
    nb = {"cells": [{"cell_type": "markdown", "source": "# Intro"}, {"cell_type": "code", "source": "x = 1"},
                    {"cell_type": "raw", "source": ["raw ", "note\n", "two"]}, {"cell_type": "markdown", "source": "End"}]}
    with open(f"{root}/a.ipynb", "w") as f:
        json.dump(nb, f)
    c = load_corpus(spark, [f"{root}/readme.md", f"{root}/missing.md"], [f"{root}/a.ipynb"], root)
    got = {r["source"]: r["text"] for r in c.collect()}
    assert got == {"readme.md": "Title\n\nSome text.", "a.ipynb": "# Intro\n\nraw note\ntwo\n\nEnd"}
    ch = chunk_corpus(c.withColumn("doc_id", c.source), ids=("doc_id", "source"))
    assert ch.count() == 2


def test_parquet_and_json_round_trip(spark):
    d = tempfile.mkdtemp(prefix="panelkit-sink-")
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "check string, value double")
    write_parquet(df, f"{d}/p")
    assert sorted(spark.read.parquet(f"{d}/p").collect()) == sorted(df.collect())
    write_json(df, f"{d}/j")
    back = read_json(spark, f"{d}/j").select("check", "value")
    assert {r["check"] for r in back.collect()} == {"a", "b"}


def test_a_thousand_files_by_list_and_by_glob(spark):
    root = tempfile.mkdtemp(prefix="panelkit-corpus-")
    for folder in ("a", "b"):
        os.mkdir(f"{root}/{folder}")
    paths = [f"{root}/{'ab'[i % 2]}/f{i}.md" for i in range(1000)]
    for i, p in enumerate(paths):
        with open(p, "w") as f:
            f.write(f" text {i}\n")
    lost = [f"{root}/a/none.md", f"{root}/c/none.md"]
    want = {(p[len(root) + 1:], f"text {i}") for i, p in enumerate(paths)}
    by_list = text_files(spark, paths + lost, root)
    assert {(r["source"], r["text"]) for r in by_list.collect()} == want
    by_glob = text_files(spark, [f"{root}/*/*.md", f"{root}/c/*.md"], root)
    assert by_glob.count() == 1000 and {(r["source"], r["text"]) for r in by_glob.collect()} == want
    assert len(present(spark, paths + lost)) == 2           # one question a folder
    assert text_files(spark, lost, root).count() == 0
