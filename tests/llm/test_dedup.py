"""Exact, near and suffix dedup against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from panelkit.llm import exact_dedup as ED
from panelkit.llm import naming as NM
from panelkit.llm import simhash as SH
from panelkit.llm import suffix_dedup as SD
from panelkit.llm.components import connected_components


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("block", [1, 7, 64, 2048])
def test_exact_groups(spark, docs_frame, noisy_docs, block):
    got = ED.exact_dedup(docs_frame, block).collect()
    groups = defaultdict(list)
    for d, t in noisy_docs:
        groups[lower(t)].append(d)
    want = Counter()
    for body, ids in groups.items():
        best = max((d for d in ids if d is not None), default=None)
        for d, n in Counter(ids).items():
            for k in range(n):
                want[d, best, len(ids), d == best and not k, hashlib.sha256(body.encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want


def test_exact_keep_one_row_and_columns(spark, docs_frame, noisy_docs):
    kept = ED.keep_one(docs_frame, ED.exact_dedup(docs_frame))
    assert kept.columns == docs_frame.columns
    bodies = Counter(lower(t) for _, t in noisy_docs)
    assert Counter(lower(r["text"]) for r in kept.collect()) == Counter(bodies.keys())


def test_exact_names_hot_values_too(spark, monkeypatch):
    monkeypatch.setattr(NM, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(i, f"v{i % 4 if i < 40 else i}") for i in range(60)], "i long, v string")
    got = NM.with_names(rows, ["v"]).collect()
    by_name = defaultdict(set)
    for r in got:
        by_name[r["name"]].add(f"v{r['i'] % 4 if r['i'] < 40 else r['i']}")
    assert len(got) == 60 and all(len(v) == 1 for v in by_name.values())
    assert len(by_name) == len({f"v{i % 4 if i < 40 else i}" for i in range(60)})


def test_exact_empty(no_docs):
    assert ED.exact_dedup(no_docs).count() == 0


def plain_fingerprint(t, k=3):
    w = lower(t).replace("\x0b", " ").split(" ")
    w = [x for y in w for x in __import__("re").split("[\x09-\x0d ]+", y) if x]
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < k else [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def unions(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_components(spark, docs_frame, noisy_docs):
    got = SH.simhash_groups(docs_frame).collect()
    fps = [(d, plain_fingerprint(t)) for d, t in noisy_docs]
    distinct = sorted({f for _, f in fps})
    root = unions([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2], distinct)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    assert Counter(map(tuple, got)) == Counter((d, f"{f:016x}", least.get(root[f])) for d, f in fps)


@pytest.mark.parametrize("cap", [1, 2, 64])
def test_simhash_links_hold_every_close_pair(spark, monkeypatch, cap):
    import random
    monkeypatch.setattr(SH, "LIST_CAP", cap)
    rng = random.Random(cap)
    fps = set()
    for _ in range(20):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            f ^= 1 << rng.randrange(64)
            f ^= (1 << rng.randrange(64)) * rng.randrange(2)
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = unions([tuple(r) for r in SH.links(nodes).collect()], signed)
    close = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert got == unions(close, signed)


def test_simhash_empty_and_wide_bits(no_docs, spark):
    assert SH.simhash_groups(no_docs).count() == 0
    with pytest.raises(ValueError):
        SH.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
    assert got == want


def plain_cut(docs):
    first = {}
    rank = [(1 << 63) - 1 if d is None else d for d, _ in docs]
    raw = [(t or "").encode() for _, t in docs]
    for d, t in zip(rank, raw):
        for i in range(len(t) - 49):
            w = t[i:i + 50]
            first[w] = min(d, first.get(w, d))
    out = []
    for (doc, _), d, t in zip(docs, rank, raw):
        gone = [False] * len(t)
        for i in range(len(t) - 49):
            if first[t[i:i + 50]] < d:
                gone[i:i + 50] = [True] * 50
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("hot", [0, 3, 2000])
def test_suffix_cut(spark, docs_frame, noisy_docs, hot):
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in SD.cut_duplicates(docs_frame, hot_runs=hot).collect()]
    want = plain_cut(noisy_docs)
    assert sum(w[2] for w in want) > 1000
    assert Counter(got) == Counter(want)


def test_suffix_periodic_texts(spark):
    docs = [(3, "ab" * 200), (1, "ab" * 60), (2, "Der " * 90 + "x" * 49), (9, "x" * 49), (8, "Der " * 30), (4, "ab" * 25 + "c" + "ab" * 30),
            (5, "q" * 120), (6, "q" * 50), (7, "q" * 49)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in SD.cut_duplicates(frame).collect()]
    assert sorted(got) == sorted(plain_cut(docs))


def test_suffix_long_text_is_split_without_losing_windows(monkeypatch):
    import numpy as np
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 5000, np.uint8))
    whole = SD.Runs([text], 0)
    covered = np.concatenate([np.arange(s, s + n) for s, n in zip(whole.start, whole.windows)])
    assert covered.tolist() == list(range(5000 - 49))
    monkeypatch.setattr(SD, "PART_BYTES", 700)
    parts = [(r.start - r.begins[r.doc - r.first_doc] + at, r) for r, at in SD.batches_of([(0, b"x" * 60), (1, text)])]
    covered = np.concatenate([np.concatenate([np.arange(a, a + n) for a, n in zip(s, r.windows)]) for s, r in parts[1:]])
    assert covered.tolist() == list(range(5000 - 49)) and {int(d) for _, r in parts[1:] for d in r.doc} == {1}


def _bucket_of(records):
    """Records of 50 + 15 bytes as ``found_before`` takes them: many anchors,
    each in a few documents, half of the texts shared."""
    rng = np.random.default_rng(5)
    texts = rng.integers(97, 123, (records // 2, 65), np.uint8)
    texts = np.concatenate([texts, texts])
    texts[records // 2:, :8] = rng.integers(97, 123, (records // 2, 8), np.uint8)
    return (rng.integers(0, 1000, records), np.full(records, 20), np.full(records, 16), texts.ravel()), texts


def test_suffix_bucket_parts():
    """Whatever the parts, the masks are those of a brute-force comparison."""
    (doc, left, windows, text), texts = _bucket_of(600)
    least = {}
    for d, t in zip(doc, texts):
        for o in range(16):
            least[o, t[o:o + 50].tobytes()] = min(d, least.get((o, t[o:o + 50].tobytes()), d))
    want = [sum(1 << o for o in range(16) if least[o, t[o:o + 50].tobytes()] < d) for d, t in zip(doc, texts)]
    assert any(want)
    for rows in (1, 7, 1000):
        assert SD.found_before(doc, left, windows, text, rows).tolist() == want


def test_suffix_bucket_in_bounded_memory():
    """Work arrays don't grow with a bucket (before: 1.7 KB a record)."""
    args, _ = _bucket_of(200_000)
    tracemalloc.start()
    SD.found_before(*args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000, peak


def test_suffix_empty(no_docs):
    assert SD.cut_duplicates(no_docs).count() == 0


def test_simhash_keeps_one_row_of_each_component(spark):
    """Null and repeated ids: one row of each component stays, no component is lost."""
    rng = random.Random(11)
    bodies = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 999)) for _ in range(80)) for _ in range(4)]
    near = lambda t: t.upper()  # noqa: E731  (same words in another case: same fingerprint, other text)
    rows = [(None, bodies[0]), (None, near(bodies[0])), (None, bodies[0]),            # a group without ids
            (1, bodies[1]), (None, near(bodies[1])), (1, bodies[2]), (1, near(bodies[1])),   # several texts under one id
            (2, bodies[2]), (3, bodies[3]), (4, near(bodies[3])), (5, None), (6, "")]
    frame = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = corpus_pipeline.near_copies(spark, frame, "")
    assert kept.columns == frame.columns
    got = kept.collect()
    prints = [SH.fingerprint(r["text"]) for r in got]
    assert sorted(prints) == sorted({SH.fingerprint(t) for _, t in rows})
    by = {p: r["doc_id"] for p, r in zip(prints, got)}
    assert [by[SH.fingerprint(b)] for b in [*bodies, ""]] == [None, 1, 1, 3, 5]
