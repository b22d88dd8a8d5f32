"""Raw-input audit on a hand frame, pruned break search, exact search
with shuffled queries, dense grids with gaps."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import breaks as BK
from panelkit.operators import quality as Q
from panelkit.operators import reshape as R
from panelkit.operators import retrieval as RT
from panelkit.operators import search as SE
from panelkit.plans import catalog
from panelkit.plans.panels import _densify


def test_raw_audit_finds_planted_faults(spark):
    rows = [(1, "a", 5.0), (1, "a", 5.0), (1, "b", -2.0), (None, "a", 1.0), (None, None, None), (4, "zz", 0.0), (5, "zz", 3.0)]
    df = spark.createDataFrame(rows, "id int, fk string, v double")
    known = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    got = {(r["check"], r["column"]): r["n"] for r in Q.audit_raw(df, "t", "id", ["v"], [("fk", known, "k")]).collect()}
    assert got == {("rows", None): 7, ("nulls", "id"): 2, ("nulls", "fk"): 1, ("nulls", "v"): 1, ("negative", "v"): 1,
                   ("duplicates", "id"): 3, ("unmapped", "fk"): 2}
    empty = {(r["check"], r["column"]): r["n"]
             for r in Q.audit_raw(df.limit(0), "t", ["id", "fk"], ["v"], [("fk", known, "k")]).collect()}
    assert len(empty) == 7 and set(empty.values()) == {0}


def optimal_cuts(d, pen, ms):
    """All starts tried for every end: no pruning."""
    s1, s2 = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    f, back = [-pen] + [np.inf] * len(d), [0] * (len(d) + 1)
    for t in range(ms, len(d) + 1):
        for s in [0, *range(ms, t - ms + 1)]:
            c = f[s] + s2[t] - s2[s] - (s1[t] - s1[s]) ** 2 / (t - s) + pen
            if c < f[t]:
                f[t], back[t] = c, s
    cuts, t = [], len(d)
    while back[t]:
        t = back[t]
        cuts.insert(0, t)
    return cuts


def _indexed(spark, series):
    rows = [(e, i, float(v)) for e, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity string, i int, value double")


@pytest.mark.parametrize("pen", [3.0, 400.0])
def test_pruned_search_equals_the_full_one(spark, pen):
    rng = np.random.default_rng(3)
    series = {f"s{k}": 1000 + np.cumsum(np.repeat(rng.normal(0, 8, 10), 25) + rng.normal(0, 3, 250)) for k in range(4)}
    series["steady"] = 7.0 * np.arange(250)
    got = {r["entity"]: r["breakpoints"] for r in BK.segment_series(_indexed(spark, series), ["entity"], pen=pen).collect()}
    for name, values in series.items():
        assert got[name] == optimal_cuts(np.diff(values), pen, BK.MIN_SEGMENT), name


def _brute_hits(x, ids, q, k):
    """By plain cosines, ties to the smaller id."""
    unit = np.array([v / (np.linalg.norm(v) or 1) for v in x])
    score = unit @ unit[q]
    order = sorted(range(len(x)), key=lambda i: (-round(score[i], 9), ids[i]))[:k]
    return [(ids[i], round(score[i], 6)) for i in order]


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_bounds_never_change_the_search(spark, monkeypatch, block_rows):
    """Clustered vectors, copies, a zero vector, another length, repeated ids."""
    monkeypatch.setattr(SE, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)) * 0.1 + rng.normal(size=(12, 6))[rng.integers(0, 12, 400)]
    x[30:90] = x[30]
    x[91] = 0
    ids = list(range(400))
    ids[399] = 5
    rows = [(i, [float(a) for a in v]) for i, v in zip(ids, x)]
    odd = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [1.0, 2.0]), (920, [2.0, 4.1]), (904, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    found = SE.search(df, df.filter("vec_id % 3 = 0 OR vec_id >= 900"), "vec_id", "embedding", 5)
    got = {}
    for r in found.hits.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["vec_id"], round(r["score"], 6)))
    want = {i: _brute_hits(x, ids, i, 5) for i in range(0, 399, 3)}
    assert {q: v for q, v in got.items() if q < 900 and q != 91} == want
    assert [i for i, _ in got[903]] == [903, 920] and set(got) - set(want) == {903, 904, 920}
    scored, all_pairs = found.work()
    assert scored <= all_pairs and (block_rows > 7 or scored < all_pairs / 2)


def test_search_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert RT.cosine_topk(df.limit(0), df).count() == 0 and RT.cosine_topk(df, df.limit(0)).count() == 0
    assert [tuple(r) for r in RT.cosine_topk(df, df, k=3).collect()] == [(1, 1, 1, 1.0)]


def test_whole_search_and_every_passage_of_a_hit(spark, tmp_path):
    """Every id divisible by 20 is a query, and later chunks of a hit are shown."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(90, 8))
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)],
                          "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "s", f"{i} " + "word " * (100 * (i % 7))) for i in range(80)],
                          "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    catalog.load_all()
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = unit @ unit.T
    want = {(q, r + 1): int(d) for q in range(0, 90, 20) for r, d in enumerate(np.argsort(-scores[q], kind="stable")[:4])}
    got = catalog.QUERIES["cosine_topk_all"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["query"], r["rank"]): r["vec_id"] for r in got} == want
    shown = catalog.QUERIES["hit_snippets_all"](spark, str(tmp_path)).collect()
    chunks = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for r in RT.chunk_corpus(docs).collect():
        chunks.setdefault(r["doc_id"], []).append(r["chunk_id"])
    assert sorted((r["query"], r["rank"], r["vec_id"], r["chunk_id"] or 0) for r in shown) == sorted(
        (q, rank, d, c) for (q, rank), d in want.items() for c in chunks.get(d, [0]))
    assert any((r["chunk_id"] or 0) > 0 for r in shown)


def test_dense_grid_fills_gaps_and_ends(spark):
    cells = spark.createDataFrame([("x", 12, 1), ("x", 15, 2), ("y", 10, 3), ("z", 16, 4)], "k string, q int, n int") \
        .select("k", "q", F.col("n").cast("decimal(20,2)").alias("v"))
    got = {}
    for r in _densify(cells, ["k"], lambda q: q.cast("string")).orderBy("k", "t").collect():
        assert r["period_label"] == str(r["t"] + 10)
        got.setdefault(r["k"], []).append(r["value"])
    assert got == {"x": [0, 0, 1, 0, 0, 2, 0], "y": [3, 0, 0, 0, 0, 0, 0], "z": [0, 0, 0, 0, 0, 0, 4]}


def test_pivot_keeps_names_without_a_column(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "new", 4.0), (1, None, 8.0), (2, "a", 16.0)],
                               "t int, name string, value double")
    got = {tuple(r) for r in R.pivot_sum_all(df, "t", "name", ["a", "b"]).collect()}
    assert got == {(1, 1.0, 2.0, 12.0), (2, 16.0, None, None)}


def test_top_lists_in_one_pass(spark):
    rng = np.random.default_rng(1)
    rows = [(f"k{i}", float(v) if i % 9 else None, float(w)) for i, (v, w) in enumerate(rng.integers(0, 30, (200, 2)))]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(7)
    lists = [("high", "a", True, 6), ("low", "a", False, 3), ("b", "b", True, 1)]
    got = {(r["list"], r["rank"]): r["k"] for r in Q.top_lists(df, ["k"], lists).collect()}
    for i, (_, c, down, n) in enumerate(lists):
        at = 1 if c == "a" else 2
        want = sorted((r for r in rows if r[at] is not None), key=lambda r: (-r[at] if down else r[at], r[0]))[:n]
        assert [got[i, k + 1] for k in range(n)] == [r[0] for r in want]
    assert len(got) == 10


def test_report_reads_the_raw_lines(spark):
    raw = spark.createDataFrame([("t", "rows", None, 9), ("t", "nulls", "a", 2), ("u", "nulls", "b", 1), ("t", "negative", "a", 0),
                                 ("t", "duplicates", "a", 0), ("u", "unmapped", "b", 4)],
                                "table string, check string, column string, n long")
    consistency = spark.createDataFrame([(3, 0.5, 0)], "n_series long, max_pct_diff double, n_inconsistent_above_1pct long")
    panel = spark.createDataFrame([("x", 0.0), ("x", 0.0), ("y", 1.0), ("z", 0.0)], "entity string, value double")
    zeros = Q.zero_entities(panel)
    assert sorted(r["entity"] for r in zeros.collect()) == ["x", "z"]
    got = {r["check"]: (r["value"], r["status"]) for r in Q.audit_report(raw, consistency, zeros).collect()}
    assert got == {"nulls": (3.0, "fail"), "duplicate_keys": (0.0, "pass"), "total_max_pct_diff": (0.5, "review"),
                   "entities_with_zeros": (2.0, "warn"), "negative_values": (0.0, "pass"), "unmapped_keys": (4.0, "warn")}


def test_counts_come_most_frequent_first(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "v string")
    assert [tuple(r) for r in Q.value_counts(df, "v").collect()] == [("c", 2), ("a", 1), ("b", 1)]


def test_checkpoint_folder_without_a_setting():
    """A fresh local session without spark.checkpoint.dir still cuts lineage."""
    code = ("from pyspark.sql import SparkSession\n"
            "from panelkit.session import checkpoint_dir, cut_lineage\n"
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "assert cut_lineage(s.range(3)).count() == 3 and checkpoint_dir(s) == checkpoint_dir(s)\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=root, env=os.environ | {"PYTHONPATH": root})
