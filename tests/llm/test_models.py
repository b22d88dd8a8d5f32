"""Quality network, URL trees, nearest neighbours; the pipeline as a whole."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from panelkit.llm import ann, quality_cnn as QC, queries, url_trees as UT

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 127, n, np.uint8)) for n in (0, 5, 300, 900)]
    labels = np.array([1, 0, 1, 0], np.float32)
    net = QC.ByteCNN(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    g = net.gradients(texts, labels)

    def loss():
        chunks, first = QC.chunks_of(texts)
        maps = net._maps(chunks)[1].max(1) + net.w["bias"]
        z = net.pool(np.maximum(maps, 0), first) @ net.w["out"] + net.w["base"][0]
        p = 1 / (1 + np.exp(-z))
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    for k in ("out", "bias", "first", "second", "embed", "base"):
        flat, grad = net.w[k].reshape(-1), g[k].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - grad[i]) < 2e-4 + 0.02 * abs(grad[i]), k


def test_chunks_cover_everything_and_overlap():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        chunks, first = QC.chunks_of([bytes([1]) * n, b"x"])
        assert (chunks[:first[1]] > 0).sum() >= n and len(chunks) == first[1] + 1
        assert first[1] == 1 or (first[1] - 1) * QC.STEP < n <= (first[1] - 1) * QC.STEP + QC.CHUNK


@needs_data
def test_quality_held_out(spark):
    rows = queries.op7_quality(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r["predicted"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    good = [p for p, q in held if q == 1]
    assert len(held) > 40 and sum(p == q for p, q in held) / len(held) >= 0.93 and sum(good) / len(good) >= 0.97


def test_quality_odd_rows(spark, docs_frame, no_docs, noisy_docs):
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    net = QC.train(docs_frame, labels, steps=3)
    rows = QC.score_documents(docs_frame, net).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in noisy_docs)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None) and len({round(r["score"], 9) for r in rows}) == 1
    assert QC.score_documents(no_docs, QC.train(no_docs, labels, steps=3)).count() == 0
    assert QC.accepted(docs_frame, net).columns == docs_frame.columns


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[n:]
    m = min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), tail[:m]


def plain_rule(host, path):
    best = None
    for action, rule in UT.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, action)
    return best or (None, None)


@needs_data
def test_url_rules(spark):
    odd = [None, "", "example.com/en/", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en/", "http://example.com/en",
           "x://com", "x://com/", "http://notexample.com/en/", "http://b.net/fr/1", "http://net/es/", "a://b://net/fr/",
           "http://u@net:80/es/", "http://ÉX.com/\nq", "http://c.net?x=/es/", "http://net#/es/", "x://", "http://org/en/?a=1&b=2"]
    pages = spark.createDataFrame([(None if k == 3 else k, u, 1, "s") for k, u in enumerate(odd)],
                                  "page_id long, url string, suffix int, said string")
    given = spark.read.parquet(f"{SF}/pages.parquet")
    for frame in (pages, given):
        urls = Counter((r["page_id"], r["url"]) for r in frame.collect())
        want = Counter()
        for (i, u), n in urls.items():
            h, p = plain_host_path(u)
            want[i, h, p, plain_rule(h, p)[0]] += n
        got = UT.judge(frame).collect()
        assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
        for r in got:
            rule, action = plain_rule(r["host"], r["path"])
            assert r["verdict"] == (action or ("block" if r["block_probability"] >= 0.5 else "allow"))
    empty = spark.createDataFrame([], "page_id long, url string")
    assert UT.judge(empty).count() == 0
    assert [r["verdict"] for r in UT.judge(spark.createDataFrame([(1, None)], "page_id long, url string")).collect()] == ["allow"]


def test_trees_learn_a_boundary():
    rng = np.random.default_rng(4)
    x = rng.random((800, len(UT.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.6)).astype(float)
    net = UT.BoostedTrees().fit(x[:600], y[:600])
    assert ((net.probability(x[600:]) >= 0.5) == y[600:]).mean() > 0.95


def plain_nearest(rows, every, k=5):
    out = {}
    for q, v in rows.items():
        if q % every:
            continue
        v = np.array(v, float)
        scored = []
        for i, w in rows.items():
            if i != q:
                w = np.array(w, float)
                scored.append((-float((v * w).sum() / (math.sqrt((v * v).sum()) * math.sqrt((w * w).sum()))), i))
        out[q] = sorted(scored)[:k]
    return out


@needs_data
def test_ann_recall(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = plain_nearest(rows, 50)
    got = queries.op4_ann(spark, SF).collect()
    hit = sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in got)
    assert len(got) == 5 * len(want) and hit / len(got) >= 0.9
    scores = {(q, i): -s for q, best in want.items() for s, i in best}
    assert all(abs(scores.get((r["query_id"], r["vec_id"]), r["score"]) - r["score"]) < 1e-12 for r in got)


def test_ann_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]),
            (6, [0.0, 0.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (9, [-1.0, 0.5]), (9, [-1.0, 0.5])]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, part int, id string")
    got = [tuple(r)[:3] for r in ann.nearest(frame, lambda i: i % 50 == 0, chunk_rows=2, block_queries=1)
           .orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 9), (0, 5, 9),
                   (50, 1, 1), (50, 2, 2), (50, 3, 9), (50, 4, 9), (50, 5, 0)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty, lambda i: i % 50 == 0).count() == 0


def test_ann_rows_of_one_id_and_lengths(spark):
    """A row is a candidate whatever its id, and each length is searched."""
    rows = [(0, [1.0, 0.0]), (9, [1.0, 0.1]), (9, [0.1, 1.0]), (0, [1.0, 1.0]), (50, [1.0, 0.0, 0.0]), (3, [1.0, 1.0, 0.0]), (4, [0.0, 0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(r["query_id"], r["vec_id"], round(r["score"], 3)) for r in ann.nearest(frame, lambda i: i % 50 == 0).collect()]
    assert sorted(got) == sorted([(0, 9, 0.995), (0, 0, 0.707), (0, 9, 0.1), (0, 9, 0.774), (0, 9, 0.774), (0, 0, 0.707),
                                  (50, 3, 0.707), (50, 4, 0.0)])


@needs_data
def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        left[name] = docs
    ids = lambda n: {r[0] for r in left[n].select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = ids("quality")
    assert sum(d in kept for d, q in labels.items() if q == 1) >= 0.97 * sum(q == 1 for q in labels.values())
    assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())
    bodies = [r["text"].lower() for r in left["exact_dedup"].collect()]
    assert len(bodies) == len(set(bodies)) and ids("exact_dedup") < kept and ids("simhash") <= ids("exact_dedup")
    assert ids("pii") == ids("simhash") == ids("packing")


@needs_data
@pytest.mark.parametrize("rows", [0, 1])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    """An empty table, and one of nulls, empty and repeated rows: columns stay,
    nothing is invented, and the pipeline's end still covers every row left."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "same text here", None, "s", 3),
           (2, "same text here", None, "s", 3), (None, "Same text HERE", "en", None, 3), (3, "é" * 5000, "fr", "s", 5000)]
    docs = spark.createDataFrame(odd if rows else [], schema)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert docs.select("doc_id").distinct().count() <= before and (before > 0) == (docs.count() > 0)
        else:
            assert docs.columns == schema.names and docs.count() <= before and (rows or not before)


@needs_data
def test_exact_dedup_matches_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(queries.ORACLES["op2_exact_dedup"]).fetchall()
    assert sorted(map(tuple, queries.op2_exact_dedup(spark, SF).collect())) == sorted(want)


def test_url_filter_with_very_long_urls(spark):
    """What the driver gets is bounded however long URLs and labels are."""
    long = "a" * 400_000
    rows = [(i, f"http://x{i}.net/{'es' if i % 2 else 'pt'}/{i}") for i in range(60)]
    rows += [(100, f"http://{long}/q"), (101, f"http://y.net/es/{long}?{long}"), (102, f"http://z.{long}/"), (103, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in UT.judge(frame).collect()}
    assert got[101]["rule"] == "net/es/" and got[101]["verdict"] == "block" and got[100]["host"] == long
    assert got[102]["host"] == f"z.{long}" and got[103]["host"] == "" and len(got) == 64
    assert all(0 <= r["block_probability"] <= 1 for r in got.values())
