"""Sharding, source audit and token alignment against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelkit.llm import sharding, source_audit, token_align
from panelkit.llm.queries import ALIGNED

PATHS = [public_tokenizers.path(p) for p in ALIGNED]


# -- sharding -------------------------------------------------------------------

def brute_shards(rows, shards):
    """Shard of every distinct text: atoms in hash order, capacity by trying."""
    size = Counter()
    for _, t in rows:
        size[t or ""] += len((t or "").encode()) + 8
    key = lambda t: hashlib.sha256(t.encode()).digest()                                # noqa: E731
    own, left, total = {}, shards, sum(size.values())
    for t in sorted(size, key=lambda t: (-size[t], key(t))):
        if not (left > 1 and size[t] * left > total):
            break
        own[t], left, total = len(own), left - 1, total - size[t]
    line = sorted((t for t in size if t not in own), key=key)

    def fill(capacity):
        out, s, used = {}, 0, 0
        for t in line:
            if used + size[t] > capacity:
                s, used = s + 1, 0
            used += size[t]
            out[t] = s + len(own)
        return out, s < left and all(size[t] <= capacity for t in line)

    low, high = 0, max(total, 1)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fill(mid)[1] else (mid + 1, high)
    return {**fill(low)[0], **own}


def check_shards(spark, rows, shards, monkeypatch=None):
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows],
                                 "doc_id long, text string, size string, shard int, before int")
    got = sharding.shard_documents(docs, shards).collect()
    want = brute_shards(rows, shards)
    by_hash = {hashlib.sha256(t.encode()).digest(): s for t, s in want.items()}
    assert all(r["shard"] == by_hash[bytes(r["atom"])] for r in got)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(
        ((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_of_noisy_documents(spark, noisy_docs):
    check_shards(spark, noisy_docs, 24)
    check_shards(spark, noisy_docs, 3)


def test_hot_atoms_get_shards_of_their_own(spark):
    rng = random.Random(2)
    rows = [(i, "hot" * 40) for i in range(80)] + [(i, "warm" * 30) for i in range(30)] + [(None, None), (None, "")] * 5
    rows += [(1000 + i, "é" * rng.randint(0, 90) + str(i)) for i in range(150)]
    check_shards(spark, rows, 24)


def test_few_atoms_and_no_rows(spark, no_docs):
    check_shards(spark, [(1, "a"), (2, "bb"), (2, "bb"), (None, None)], 24)
    assert sharding.shard_documents(no_docs).count() == 0


@pytest.mark.parametrize("grid", [1, 3, 1000])
def test_cuts_do_not_depend_on_the_grid(spark, monkeypatch, grid):
    rng = random.Random(grid)
    sizes = [rng.choice([1, 2, 9, 40, 300]) for _ in range(400)]
    ends = list(accumulate(sizes))
    line = spark.createDataFrame([(e,) for e in ends], "e long")
    monkeypatch.setattr(sharding, "GRID", grid)
    got = sharding.minimax_cuts(line, "e", ends[-1], max(sizes), 7)
    known = sharding.Landmarks(ends[-1])
    known.at, known.unseen = [0, *ends], [False] * len(ends)
    best = known.smallest(7, max(sizes), ends[-1], False)
    assert got == known.greedy(best, 7, False)


def test_written_shards_hold_their_rows(spark, docs_frame, tmp_path):
    want = Counter((r["doc_id"], r["shard"]) for r in sharding.shard_documents(docs_frame, 5).collect())
    sharding.write_shards(docs_frame, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["shard"]) for r in back.collect()) == want
    assert {"keep_id", "fp", "text"} <= set(back.columns)


# -- source audit ---------------------------------------------------------------

def brute_audit(rows, min_docs=3, top=200):
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)
        groups.add((lang, source))
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        v = len(kept)
        p = lambda c, size, t: 1 + 10**9 * (c[t] + 1) // (size + v)                    # noqa: E731
        size = lambda c: sum(c[t] for t in kept)                                       # noqa: E731
        mine, whole = n[lang, source], sum((n[g] for g in groups if g[0] == lang), Counter())
        f = lambda a, b: (a - b) ** 2 // b                                             # noqa: E731
        sm, sw = size(mine), size(whole)
        pairs = [(o, sum(f(p(mine, sm, t), p(n[lang, o], size(n[lang, o]), t)) for t in kept))
                 for g, o in groups if g == lang and o != source]
        over = [(t, f(p(mine, sm, t), p(whole, sw, t))) for t in kept if mine[t] and p(mine, sm, t) > p(whole, sw, t)]
        for part, items, most in (("pair", pairs, None), ("term", over, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, i, x, k + 1) for k, (i, x) in enumerate(items[:most])}
    return out


def audit_rows(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, source string, n int, term string")
    audit = source_audit.audit_sources(docs, **options)
    return {(r["lang"], r["source"], part, r["item"], r["value"], r["rank"])
            for part, d in (("pair", audit.pairs), ("term", audit.terms)) for r in d.collect()}


def audit_sample(seed, sources, words):
    rng = random.Random(seed)
    rows = [(" ".join(rng.choice(["Aé", "b", "日本", "x-y", "Zz9q"]) + rng.choice("abcdefgh") * rng.randint(0, words)
                      for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]),
             rng.choice([None, *(f"s{i}" for i in range(sources))])) for _ in range(150)]
    return rows + [(None, "xx", "lonely"), ("", "yy", "a"), ("one two", "yy", None), ("  \x7f12 ", "yy", "é")]


def test_audit_against_brute_force(spark, monkeypatch):
    rows = audit_sample(1, 5, 6)
    want = brute_audit(rows)
    assert audit_rows(spark, rows) == want
    # blocks of three terms and tiles of two sources
    for name, value in (("BLOCK", 3), ("TILE", 2)):
        monkeypatch.setattr(source_audit, name, value)
    assert audit_rows(spark, rows) == want


def test_counts_are_handed_on_in_bounded_tables(monkeypatch):
    rows = [(t, lang or "", source or "") for t, lang, source in audit_sample(4, 3, 5)]
    text, lang, source = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array([(t or "").encode() for t in text]), pa.array(lang), pa.array(source)],
                                       ["text", "lang", "source"])

    def totals():
        out = defaultdict(lambda: np.zeros(2, int))
        for rb in source_audit._count_terms(iter([batch])):
            for *key, n, docs in zip(*(c.to_pylist() for c in rb.columns)):
                out[tuple(key)] += (n, docs)
        return {k: tuple(v) for k, v in out.items()}

    want = totals()
    monkeypatch.setattr(source_audit, "TALLY_ENTRIES", 7)
    monkeypatch.setattr(source_audit, "TEXT_BYTES", 5)
    assert totals() == want and len(want) > 20


def test_audit_limits_terms_and_takes_empty_tables(spark):
    rows = audit_sample(2, 2, 9)
    got = audit_rows(spark, rows, top_terms=2)
    assert got == {r for r in brute_audit(rows) if r[2] == "pair" or r[5] <= 2}
    assert audit_rows(spark, rows, min_docs=10**6) == {
        r for r in brute_audit(rows, min_docs=10**6)} and all(r[4] == 0 for r in brute_audit(rows, min_docs=10**6))
    assert audit_rows(spark, []) == set()


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_gallop_finds_first_positions(a, b):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    assert source_audit.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**12), max_size=5), st.integers(0, 10**14), st.integers(1, 10**9))
def test_smoothing_is_exact(counts, more, terms):
    size = sum(counts) + more
    assert source_audit.smoothed(np.array(counts, np.int64), size, terms).tolist() == [
        1 + 10**9 * (c + 1) // (size + terms) for c in counts]


# -- token alignment ------------------------------------------------------------

@pytest.fixture(scope="module")
def aligner():
    with open(PATHS[0], encoding="utf-8") as a, open(PATHS[1], "rb") as b:
        return token_align.Aligner(a.read(), b.read())


def brute_alignment(rows, al):
    docs, held = [], Counter()
    for d, t in rows:
        spaced = (" " + t).encode() if t else b""
        a = al.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = al.b.encode(t) if t else []
        at, bt = [al.a_bytes[i] for i in a], [al.b_bytes[i] for i in b]
        if b"".join(at) != spaced or b"".join(bt) != spaced or not t:
            docs.append((d, [], [], [], []))
            continue
        ae, be = list(accumulate(map(len, at))), list(accumulate(map(len, bt)))
        links, j = [], 0
        for i, e in enumerate(ae):
            while j and be[j - 1] > e - len(at[i]):
                j -= 1
            while j < len(b) and be[j] - len(bt[j]) < e:
                if be[j] > e - len(at[i]):
                    links.append((a[i], b[j]))
                j += 1
        groups, p = [], 0
        for c in sorted(set(ae) & set(be)):
            inside = lambda ids, ends: ",".join(str(x) for x, e in zip(ids, ends) if p < e <= c)  # noqa: E731, B023
            groups.append(inside(a, ae) + "|" + inside(b, be))
            p = c
        docs.append((d, a, b, links, groups))
        held.update(set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [(d, len(a), len(b), len(g), len(x), sum(held[y] == best[y[0]] for y in x), sum(held[y] for y in x),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, x, g in docs], held


ODD = ["a  b", " lead", "trail ", "trail  ", " ", "  ", "x\n y\n\n  z", "t\t u", "w  v", "<|endoftext|> <s> </s>",
       "▁ mark inside", "no▁mark", "日本 語の　文", "'s it's", "é é ﬁ", "\x1c \x85 q", "0123456789 " * 9]


def test_units_are_encoded_as_the_whole_text_is(aligner):
    rng = random.Random(3)
    alphabet = ["a", "b c", " ", "  ", "\n", "\t", " ", "é", "日", "’", "'s", "<|endoftext|>", ".", " ", "9"]
    for t in ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(500)]:
        got = aligner.align(token_align.units_of(" " + t))
        if not got.good.all():
            assert "▁" in t
            continue
        ids = [[int(i) for g in got.texts for x in g.decode().split(";") for i in x.split("|")[side].split(",")]
               for side in (0, 1)]
        assert ids == [aligner.a.encode(" " + t, add_special_tokens=False).ids, aligner.b.encode(t)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é日 \n", min_size=1, max_size=40), st.lists(st.integers(1, 60), max_size=8), st.randoms())
def test_fragments_compose_in_any_bracketing(text, at, rng):
    raw = (" " + text).encode()
    ends = sorted({min(x, len(raw)) for x in at} | {len(raw)})
    chunks = [raw[a:b] for a, b in zip([0, *ends], ends)]
    nodes, closed = [], {}
    for k, c in enumerate(chunks):
        f, inside = token_align.fragment(k, c)
        nodes.append(f)
        closed[token_align.place_inside(k)] = inside
    while len(nodes) > 1:
        i = rng.randrange(len(nodes) - 1)
        seam = token_align.place_before(nodes[i + 1][0])
        nodes[i:i + 2], closed[seam] = [(x := token_align.compose(nodes[i], nodes[i + 1]))[0]], x[1]
    closed[0], closed[2 * len(chunks)] = nodes[0][1], nodes[0][2] or b""
    parts = [closed[k].decode() for k in sorted(closed) if closed[k]]       # whole characters
    assert "".join(parts) == " " + text
    assert [u for p in parts for u in token_align.units_of(p)] == token_align.units_of(" " + text)


def test_alignment_against_brute_force(spark, noisy_docs, aligner):
    rows = noisy_docs + [(900 + i, t) for i, t in enumerate(ODD)] + [(990, "word▁ " * 60)]
    want, held = brute_alignment(rows, aligner)
    docs = spark.createDataFrame([(d, t, 1, "p", "r") for d, t in rows],
                                 "doc_id long, text string, row int, place string, pairs string")
    for chunk in (token_align.CHUNK_BYTES, 300):
        got = token_align.align(docs, *PATHS, chunk_bytes=chunk)
        assert sorted(map(tuple, got.documents.collect()), key=str) == sorted(want, key=str)
    assert {(r["a"], r["b"]): r["docs"] for r in got.pairs.collect()} == dict(held)
    text = got.parts.filter(F.col("doc_id") == 506).orderBy("place").collect()      # a long document's groups
    assert hashlib.sha256(";".join(r["groups"] for r in text if r["groups"]).encode()).hexdigest() == next(
        w[7] for w in want if w[0] == 506)
    small = token_align.align(docs, *PATHS, chunk_bytes=2000, batch_bytes=500)
    assert sorted(map(tuple, small.documents.collect()), key=str) == sorted(want, key=str)


def test_alignment_of_no_rows(spark, no_docs):
    assert token_align.align(no_docs, *PATHS).documents.count() == 0
