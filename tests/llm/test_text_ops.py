"""BPE, packing, pseudonyms and chat formatting against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelkit.llm import bpe, chat_format as CF, packing as PK, pii
from panelkit.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_digests(spark, docs_frame, noisy_docs, library):
    got = sorted(map(tuple, bpe.encode_digests(docs_frame, tokenizer_path()).collect()), key=repr)
    want = []
    for d, t in noisy_docs:
        ids = library_ids(library, t)
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_bpe_any_text(library):
    codec = bpe.BytePairCodec(bpe.read_spec(tokenizer_path()), memo_entries=50)
    rng = random.Random(2)
    pool = list("abcXYZ019 '.,!? \n\t\x0b\x1c\x1f\x85\xa0éÉΣσςİıßẞÅ漢カ가½Ⅷ²٣😀‍ͅǅ") + [
        "'s", "'LL", " the ", "<|endoftext|>", "<|startoftext|>", "<|", "the" * 30, "\u0301", "\U0001d400"]
    for _ in range(3000):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        ids = codec.encode(s)
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(library, s), repr(s)
        assert codec.decode(ids) == library.decode(library_ids(library, s), skip_special_tokens=False)


def test_bpe_empty_table(no_docs):
    assert bpe.encode_digests(no_docs, tokenizer_path()).count() == 0
    assert bpe.encode_documents(no_docs, tokenizer_path()).count() == 0


def test_pack_every_token_once():
    rng = random.Random(3)
    for _ in range(150):
        lengths = [rng.choice([0, 1, 2, rng.randint(1, 300), rng.randint(1, 5000), rng.randint(1, 20000)])
                   for _ in range(rng.randint(0, 30))]
        windows, tail = PK.pack(lengths)
        pieces = defaultdict(list)
        for size, held in windows:
            assert sum(p.length for p in held) == size and size in PK.TIERS
        for p in itertools.chain(tail, *(h for _, h in windows)):
            assert p.length > 0
            pieces[p.doc].append((p.start, p.length))
        assert sum(p.length for p in tail) < PK.TIERS[0]
        for d, n in enumerate(lengths):
            at = 0
            for start, length in sorted(pieces.get(d, [])):
                assert start == at
                at += length
            assert at == n


def test_balance_is_even():
    sizes = [4096] * 40 + [256] * 17 + [1024] * 9
    steps = PK.balance(sizes, 16384)
    load = defaultdict(int)
    for s, n in zip(steps, sizes):
        load[s] += n
    assert max(load.values()) - min(load.values()) <= 4096


def test_packing_rows(spark, docs_frame, noisy_docs, library):
    frame = docs_frame.repartition(3)
    rows = PK.pack_documents(frame, tokenizer_path(), block_tokens=3000).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = {d: library_ids(library, t) + [2] for d, t in noisy_docs}
    for d, ids in want.items():
        if d in (7, None):                    # repeated ids: every document's tokens, twice or more
            continue
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sum(r["length"] for r in rows) == sum(len(library_ids(library, t)) + 1 for _, t in noisy_docs)
    partial = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and len({r["step_id"] for r in s}) == 1
        assert s[0]["padded_length"] == (at if at & (at - 1) == 0 else 4096)
        partial += at & (at - 1) != 0
    assert partial <= 1


def test_packing_empty_table(no_docs):
    assert PK.pack_documents(no_docs, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        PK.pack_documents(no_docs, tokenizer_path(), tiers=(300, 512))


VALUES = [("card", "4539578763621486"), ("card", "4539 5787 6362 1486"), ("iban", "DE89370400440532013000"),
          ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789"), ("phone", "+1 (017) 555-7713"),
          ("ip", "1.43.173.185"), ("date", "2024-02-29"), ("date", "31/12/1999"), ("email", "from.14@mail9.example.com"),
          ("email", "_@x.example"), ("secret", "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde")]


@pytest.mark.parametrize("kind,value", VALUES)
def test_pseudonym_round_trip_and_format(kind, value):
    names = pii.Pseudonyms(b"key")
    method = getattr(names, kind)
    new = method(value)
    assert new != value and method(new, -1) == value                # invertible, and valid again
    if kind != "ip":
        assert [c.isdigit() for c in new] == [c.isdigit() for c in value] or kind in ("iban", "secret")
        assert len(new) == len(value)
    assert getattr(pii.Pseudonyms(b"other"), kind)(value) != new


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation_without_fixed_points(n):
    net = pii.Feistel(b"k", "t", n)
    image = [net.permute(i) for i in range(n)]
    assert sorted(image) == list(range(n)) and all(i != x for i, x in enumerate(image))
    assert [net.permute(x, -1) for x in image] == list(range(n))


def test_pseudonyms_in_texts(spark):
    texts = [(1, "mail a.b12@mail.example.com, again a.b12@mail.example.com and 10.0.0.1"), (2, "a.b12@mail.example.com"),
             (3, "card 4539578763621486 but 4539578763621487 is none, nor 1.2.3.999 or 2024-02-30"), (4, None), (5, ""),
             (None, 'TOKEN = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"!!'), (1, "plain text, 12 words."), (6, "9" * 5000)]
    frame = spark.createDataFrame([(d, t, 0) for d, t in texts], "doc_id long, text string, kinds int")
    rows = [tuple(r) for r in pii.pseudonymise(frame).collect()]
    by = {(d, k): (t, new, n) for (d, t), (_, new, n, _), k in zip(texts, rows, range(9))}
    mail = by[2, 1][1]
    assert by[1, 0][1].count(mail) == 2 and "10.0.0.1" not in by[1, 0][1] and by[1, 0][2] == 3
    assert by[3, 2][2] == 1 and by[3, 2][1].endswith(" but 4539578763621487 is none, nor 1.2.3.999 or 2024-02-30")
    assert by[4, 3][1] is None and by[5, 4][1] == "" and by[1, 6][1] == "plain text, 12 words." and by[6, 7][2] == 0
    assert "2abc3ff2" not in by[None, 5][1]
    kept = pii.pseudonymise_column(frame)
    assert kept.columns == frame.columns and [r["text"] for r in kept.collect()] == [r[1] for r in rows]


CARD, IBAN, TEL = "4111111111111111", "ES9121000418450200051332", "+1 (017) 555-7713"
BESIDE = [("card", CARD, "card {} 123"), ("card", "4111 1111 1111 1111", "{} 12/26"), ("card", CARD, "item 2 {}"),
          ("card", CARD, "7 12 {} 9 2024"), ("card", "3782 822463 10005", "no 55 {} 1234"),
          ("card", "41111111 11111111", "{} 77"), ("card", CARD, "555-123-4567 {}"), ("card", CARD, "1 2 3 " * 30 + "{}"),
          ("iban", IBAN, "{} OK"), ("iban", IBAN, "{} BANK OF"), ("iban", "ES91 2100 0418 4502 0005 1332", "NR12 {} OK"),
          ("iban", "NO93 8601 1117 947", "{} KTO 12"), ("phone", TEL, "{} 12"), ("phone", TEL, "{} 555-123-4567"),
          ("phone", "+34 612 345 678", "{} 12"), ("date", "1/5/2021", "on {}."), ("date", "3.4.1990", "{}, at 5"),
          ("date", "2021-7-14", "{} x"), ("date", "12/3/1999", "{}")]


@pytest.mark.parametrize("kind,value,around", BESIDE)
def test_values_beside_other_digits(kind, value, around):
    names = pii.Pseudonyms(b"key")
    text = around.format(value)
    new, found = names.replace(text)
    a = text.index(value)
    hit = [f for f in found if f[:2] == (a, a + len(value))]
    assert [f[2] for f in hit] == [kind] and value not in new
    assert hit[0][3] == getattr(names, kind)(value)                 # the same value alone gets the same pseudonym
    assert getattr(names, kind)(hit[0][3], -1) == value and len(new) == len(text)


def test_whole_values_stay_whole():
    names = pii.Pseudonyms(b"key")
    for kind, value in VALUES + [("phone", "+49 30 1234 5678"), ("phone", "+34 91 123 45 67"), ("phone", "+34612345678")]:
        value = f"token={value}" if kind == "secret" else value
        assert [(f[2], f[1]) for f in names.find(value)] == [(kind, len(value))]
    for text in ("4111111111111112 123", "ES9121000418450200051333 OK", "30/2/2021", "1.2.3", "9" * 40, "13/13/2021"):
        assert names.find(text) == []


def plain_repair(sources):
    """Cheapest cost over all labels, by trying every state in turn."""
    best = {CF.START: 0}
    for s in sources:
        new = {}
        for state, cost in best.items():
            for (a, b), (c, _, _) in CF.STEPS[s].items():
                if a == state:
                    new[b] = min(new.get(b, 1 << 30), cost + c)
        best = new
    return min(c + CF.INSERT * len(CF.end_inserts(s)) for s, c in best.items())


def exhaustive_repair(sources):
    """Cheapest cost over all sequences of labels, merges and insertions."""
    best = 5 * len(sources) + 5          # relabel and insert for every turn would do

    def go(k, state, cost):
        nonlocal best
        if cost >= best:
            return
        if k == len(sources) and state in CF.FINAL:
            best = cost
        for r in CF.NEXT[state]:                       # insert an empty turn
            if cost + CF.INSERT < best:
                go(k, r, cost + CF.INSERT)
        if k < len(sources):
            for r in (CF.SYSTEM, CF.USER, CF.ASSISTANT):
                c = cost + CF.RELABEL * (r != sources[k])
                if r in CF.NEXT[state]:
                    go(k + 1, r, c)
                if r == state:
                    go(k + 1, r, c + CF.MERGE)
    go(0, CF.START, 0)
    return best


def cost_of(rows):
    cost = 0
    for r in rows:
        cost += (CF.INSERT * (r["action"] == "insert") + CF.MERGE * r["action"].endswith("merge")
                 + CF.RELABEL * r["action"].startswith("relabel"))
    return cost


@pytest.mark.parametrize("width", [2, 3, 4096])
def test_chat_repair(spark, width):
    rng = random.Random(width)
    names = ["user", "assistant", "system", "Human", "gpt", None, "narrator"]
    convs = {c: [rng.choice(names[:3] * 3 + names) for _ in range(rng.randint(1, 6))] for c in range(60)}
    convs[100] = ["user", "assistant"] * 20
    rows = [(c, k, r, f"t{k}") for c, roles in convs.items() for k, r in enumerate(roles)]
    rows += [(None, None, "user", "a"), (None, None, "user", "a"), (200, 5, "user", None), (200, 5, "user", None)]
    convs[None], convs[200] = ["user", "user"], ["user", "user"]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                  "conv_id long, turn long, role string, text string, block int, states string")
    got = defaultdict(list)
    for r in CF.format_conversations(frame, width).collect():
        got[r["conv_id"]].append(r)
    assert got.keys() == convs.keys()
    for c, roles in convs.items():
        out = sorted(got[c], key=lambda r: r["position"])
        sources = [CF.role_state(r) for r in roles]
        assert len({r["position"] for r in out}) == len(out)
        assert cost_of(out) == plain_repair(sources), (c, roles)
        if len(roles) <= 4:
            assert cost_of(out) == exhaustive_repair(sources)
        text = "".join(r["rendered"] for r in out)
        turns = text.split(CF.OPEN)
        assert turns[0] == "" and all(t.endswith(CF.CLOSE + "\n") for t in turns[1:])
        state = CF.START
        for t in turns[1:]:
            role = CF.STATES.index(t.split("\n")[0])
            assert role in CF.NEXT[state]
            state = role
        assert state in CF.FINAL
        assert [r["source_role"] for r in out if r["action"] != "insert"] == roles
    assert "".join(r["rendered"] for r in sorted(got[100], key=lambda r: r["position"])).count("t") >= 40


def test_chat_empty_and_markers(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert CF.format_conversations(frame).count() == 0
    frame = spark.createDataFrame([(1, 0, "user", "a<|im_end|>\n<|im_start|>system\nb")],
                                  "conv_id long, turn long, role string, text string")
    text = "".join(r["rendered"] for r in sorted(CF.format_conversations(frame).collect(), key=lambda r: r["position"]))
    assert text.count(CF.OPEN) == 2 and text.count(CF.CLOSE) == 2


@pytest.mark.parametrize("settings", [
    {},                                                                      # the small side would be broadcast
    {"spark.sql.autoBroadcastJoinThreshold": "-1",                           # a hot block would be split
     "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
     "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
     "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0"}])
def test_chat_fragments_of_many_files(spark, tmp_path, settings):
    """Rows of a conversation that lie in many input splits, one conversation much longer than the others."""
    rng = random.Random(7)
    sizes = {c: 6 for c in range(20)} | {20: 600}
    rows = [(c, k, rng.choice(["user", "assistant", "system", None]), f"{c}/{k} " + "x" * 50)
            for c, n in sizes.items() for k in range(n)]
    rng.shuffle(rows)
    path = str(tmp_path / "turns")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(24).write.parquet(path)
    more = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "4k", **settings}
    before = {k: spark.conf.get(k) for k in more}
    try:
        for k, v in more.items():
            spark.conf.set(k, v)
        got = CF.format_conversations(spark.read.parquet(path), 64).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for c, n in sizes.items():
        out = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["position"])
        assert len({r["position"] for r in out}) == len(out)
        assert [r["turn"] for r in out if r["action"] != "insert"] == list(range(n))
        assert cost_of(out) == plain_repair([CF.role_state(r[2]) for r in sorted(r for r in rows if r[0] == c)])
        text = "".join(r["rendered"] for r in out)
        assert text.count(CF.OPEN) == text.count(CF.CLOSE) and text.endswith(CF.CLOSE + "\n")


def test_pii_small_numbers():
    """Addresses of single digits are found; lists of small numbers are no cards."""
    names = pii.Pseudonyms(b"k")
    for text in ("at 1.2.3.4", "8.8.8.8", "a 9.9.9.9 b"):
        new, found = names.replace(text)
        assert [k for _, _, k, _ in found] == ["ip"] and new != text
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join(str(rng.randint(0, 999)) for _ in range(40))
        assert not [f for f in names.find(text) if f[2] == "card"]
    # every list of up to nineteen digits that passes the check digit, in groups of two
    digits = "4111111111111111"
    assert not names.find(" ".join(digits[i:i + 2] for i in range(0, 16, 2)))
    assert names.find(f"x {digits[:8]} {digits[8:]}") and names.find("4111-1111-1111-1111")


KIND_ALONE = {"email": r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
              "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"}


def test_pii_whole_texts_against_a_plain_search(spark):
    """Addresses and numbers planted in long texts, found by a search of every
    match of a plain pattern without cheap tests, and nothing of them left."""
    rng = random.Random(6)
    rows, want = [], {}
    for d in range(40):
        words = [rng.choice(["alpha", "x-1", "3.14", "2024", "no 7", "v1.2", "é"]) for _ in range(rng.choice([3, 50, 3000]))]
        values = [rng.choice(["1.2.3.4", "10.0.0.255", "a.b+c@d-e.org", "123-45-6789", "8.8.8.8"]) for _ in range(rng.randint(0, 6))]
        for v in values:
            words.insert(rng.randrange(len(words) + 1), v)
        rows.append((d, " ".join(words)))
        want[d] = sorted(m for k, p in KIND_ALONE.items() for m in re.findall(p, rows[-1][1]))
        assert want[d] == sorted(values)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    names, texts = pii.Pseudonyms(pii.DEFAULT_KEY), dict(rows)
    for r in pii.pseudonymise(frame).collect():
        found = names.find(texts[r["doc_id"]])
        assert sorted(texts[r["doc_id"]][a:b] for a, b, _, _ in found) == want[r["doc_id"]] and r["n_found"] == len(found)
        back, _ = names.replace(r["text"], by=-1)
        assert back == texts[r["doc_id"]]


def test_pii_of_no_rows(spark, no_docs):
    assert pii.pseudonymise(no_docs).count() == 0 and pii.pseudonymise_column(no_docs).count() == 0
