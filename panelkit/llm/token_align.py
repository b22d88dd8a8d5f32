"""Alignment of two tokenizers' tokens over the same text (operator 13).

Both tokenizers encode ``space + text``; byte offsets where a token of A and a
token of B both end cut the document into groups, and every A and B token
whose byte ranges overlap are linked.

Neither tokenizer joins anything across a *cut*: a space that follows a
character that is not white space.  (A's splitting pattern has no alternative
that matches such a pair; B has no piece with its space mark behind another
character, which is checked when it is loaded.)  So the text between two cuts
is a unit that can be tokenised on its own, and its ends are ends of tokens of
both.  That makes alignment a monoid of fragments.  A byte-range chunk, cut
anywhere (inside a word or a character too), gives

* an open prefix: the bytes before its first cut,
* closed groups: all units between its first and its last cut,
* an open suffix: the bytes behind its last cut

or, without any cut, one open run.  Composing two neighbours closes what lies
between the left one's last and the right one's first cut, so fragments of a
very long document are reduced in a tree over Spark tasks, in any bracketing.
Only open bytes travel up the tree; closed text is put aside under its place
in the document and is tokenised by whichever task gets it.

Counts of linked id pairs are over documents.  Tasks gather documents in
batches of bounded bytes with one dictionary of units and one of id pairs, so
that the pairs that are shuffled are those of a batch, not those of a document.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet, read_spec
from .common import columns_of, cut_lineage, doc_columns, text_bytes

CHUNK_BYTES = 64 << 10      # a longer document is cut into byte ranges of this size
BATCH_BYTES = 24 << 20      # text whose units share one dictionary
BATCH_UNITS = 400_000
JOINED = 4_096              # units encoded together
ARITY = 8                   # fragments that a task composes at a time
B_BITS = 32                 # an id pair is (A's id << 32) + B's id
SPACE_MARK = "\u2581"       # fixed value: B's sign for a space

#: A cut is in front of a space behind a visible character; a space that ends
#: the whole text stays with the unit before it.
_CUT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
_NOT_PLAIN = re.compile(r"\s | \Z")
#: UTF-8 of the white space characters beyond ASCII.
_WIDE_SPACE = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                                             0x205F, 0x3000))


# -- units: tokens of the text between two cuts ------------------------------

def units_of(spaced: str) -> list[str]:
    """The units of a text that begins with a space, each without the one
    space it begins with."""
    if _NOT_PLAIN.search(spaced):
        return [u[1:] for u in _CUT.split(spaced)]
    return spaced[1:].split(" ")


class Aligned:
    """Alignment of a list of units: ``good`` (whether the tokens' bytes are
    the unit's), ``figures`` (tokens of A and of B, groups, links), ``texts`` of
    the groups, and the links as id pairs, unit by unit from ``ptr``."""

    def __init__(self, good, figures, texts, ptr, links):
        self.good, self.figures, self.texts, self.ptr, self.links = good, figures, texts, ptr, links


class Aligner:
    """Both tokenizers (built once per worker)."""

    def __init__(self, a_spec: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.a_bytes[i] = s.encode() if s in special else bytes(byte_of[c] for c in s)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("a piece of B joins text across a space, so units can't be encoded on their own")
        self.ranked = self._ranked(vocab)
        self.lengths = [np.array([len(b) for b in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        # an id with what follows it: another one of its side, or the end of its side's part of a group
        self.shown = [f"{i}{end}".encode() for table, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))
                      for end in ends for i in range(len(table))]
        self.shown_from = np.cumsum([0, len(self.a_bytes), len(self.a_bytes), len(self.b_bytes)])

    def _ranked(self, vocab: dict[str, int]):
        """A as a list of ranks, which is much faster, or None.

        Merging the pair whose joint bytes have the least id is the same as
        merging by A's list of pairs if every entry of the vocabulary, taken by
        itself, merges to itself: as long as no merge has reached over the ends
        of some bytes, they merge as they do by themselves.  So that is checked,
        and that pairs are listed in the order of the ids they make.  It serves
        text below U+0530, where all Unicode tables agree on letters and digits.
        """
        import json

        import public_tokenizers
        import tiktoken
        spec = json.loads(self.a.to_str())
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        split = spec["pre_tokenizer"]
        plain = [s for s in vocab if s not in {t["content"] for t in spec["added_tokens"]}]
        if (split["type"], split.get("use_regex"), spec["normalizer"]) != ("ByteLevel", True, None) or made != sorted(made) \
                or any(len(self.a.model.tokenize(s)) != 1 for s in plain):
            return None
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks={self.a_bytes[vocab[s]]: vocab[s] for s in plain})

    def ids_a(self, text: str) -> np.ndarray:
        if self.ranked is not None and max(text) < "\u0530":
            return np.array(self.ranked.encode_ordinary(text), np.int64)
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)

    def align(self, units: list[str]) -> Aligned:
        """Align many units at a time: A encodes them joined again, as nothing
        reaches over a cut, and all offsets are compared as arrays.  A unit
        that ends in white space can't be followed by another one, and a unit
        whose bytes don't come back spoils its neighbours, so these are encoded
        on their own."""
        parts, at = [], 0
        while at < len(units):
            some = units[at:at + JOINED]
            at += len(some)
            if not any(not u or u[-1].isspace() for u in some) and (got := self._joined(some)):
                parts.append(got)
            else:
                parts += [self._joined([u]) or Aligned(np.zeros(1, bool), np.zeros((1, 4), np.int64), [b""],
                                                       np.zeros(2, np.int64), np.zeros(0, np.int64)) for u in some]
        if not parts:
            return Aligned(np.zeros(0, bool), np.zeros((0, 4), np.int64), [], np.zeros(1, np.int64), np.zeros(0, np.int64))
        ptr = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.ptr) for p in parts]))])
        return Aligned(np.concatenate([p.good for p in parts]), np.concatenate([p.figures for p in parts]),
                       [t for p in parts for t in p.texts], ptr, np.concatenate([p.links for p in parts]))

    def _joined(self, units: list[str]) -> Aligned | None:
        text = " " + " ".join(units)
        raw = text.encode("utf-8", "surrogatepass")
        a, b = self.ids_a(text), list(chain.from_iterable(self.b.encode(units, num_threads=1)))
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        lengths = map(len, units) if text.isascii() else (len(u.encode("utf-8", "surrogatepass")) for u in units)
        ends = np.cumsum(np.fromiter(lengths, np.int64, len(units)) + 1)
        return self.aligned(a, np.array(b, np.int64), ends)

    def aligned(self, a: np.ndarray, b: np.ndarray, unit_ends: np.ndarray) -> Aligned:
        """Groups and links of the token ids ``a`` and ``b`` of one text, per
        unit.  Between two neighbouring ends, of whichever side, lies the overlap
        of one token of A and one of B, and every overlap is such a stretch."""
        ends = [np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])]
        every = np.union1d(*ends)
        common = np.intersect1d(*ends, assume_unique=True)
        links = (a[np.searchsorted(ends[0], every)] << B_BITS) + b[np.searchsorted(ends[1], every)]
        upto = [np.searchsorted(e, unit_ends, "right") for e in (*ends, common, every)]
        figures = np.stack([np.diff(u, prepend=0) for u in upto], 1)
        # tokens in the order of the groups' text: by group, then A before B
        group = [np.searchsorted(common, e) for e in ends]
        last = [e == common[g] for e, g in zip(ends, group)]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        what = np.concatenate([a + self.shown_from[last[0].astype(np.int64)], b + self.shown_from[2 + last[1].astype(np.int64)]])
        shown = [self.shown[i] for i in what[order].tolist()]
        stop = (upto[0] + upto[1]).tolist()
        texts = [b"".join(shown[i:j])[:-1] for i, j in zip([0, *stop], stop)]
        return Aligned(np.ones(len(unit_ends), bool), figures.astype(np.int64), texts,
                       np.concatenate([[0], upto[3]]), links)


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(a_spec: str, b_model: bytes) -> Aligner:
    key = hashlib.sha256(a_spec.encode() + b_model).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a_spec, b_model)
    return _ALIGNERS[key]


# -- the fragment monoid ------------------------------------------------------

def is_cut(raw: bytes, at: int) -> bool:
    """Whether the space at ``at`` is surely a cut, from these bytes alone."""
    if at < 1 or at + 1 >= len(raw):
        return False
    prev = raw[at - 1]
    if prev < 0x80:
        return prev > 0x20 and prev != 0x7F
    return at >= 4 and not raw.endswith(_WIDE_SPACE, at - 4, at)


def outer_cuts(raw: bytes) -> tuple[int, int] | None:
    """The first and the last cut inside ``raw``."""
    at = raw.find(b" ")
    while at >= 0 and not is_cut(raw, at):
        at = raw.find(b" ", at + 1)
    if at < 0:
        return None
    end = raw.rfind(b" ")
    while not is_cut(raw, end):
        end = raw.rfind(b" ", 0, end)
    return at, end


#: A fragment is (first chunk, prefix, suffix); suffix is None for an open run.
Fragment = tuple[int, bytes, bytes | None]


def fragment(chunk: int, raw: bytes) -> tuple[Fragment, bytes]:
    """A chunk's fragment and its closed text."""
    cuts = outer_cuts(raw)
    if cuts is None:
        return (chunk, raw, None), b""
    return (chunk, raw[:cuts[0]], raw[cuts[1]:]), raw[cuts[0]:cuts[1]]


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, bytes]:
    """``x`` followed by ``y``, and the text that closes where they meet.

    The meeting bytes are looked through again, as each side may show the
    other that a space at the seam is a cut."""
    left, right = (x[1] if x[2] is None else x[2]), y[1]
    raw = left + right
    if x[2] is not None and y[2] is not None:
        return (x[0], x[1], y[2]), raw
    cuts = outer_cuts(raw)
    if x[2] is None and y[2] is None:
        return ((x[0], raw, None), b"") if cuts is None else \
            ((x[0], raw[:cuts[0]], raw[cuts[1]:]), raw[cuts[0]:cuts[1]])
    if x[2] is None:                        # raw ends at a cut
        return ((x[0], raw, y[2]), b"") if cuts is None else ((x[0], raw[:cuts[0]], y[2]), raw[cuts[0]:])
    return ((x[0], x[1], raw), b"") if cuts is None else ((x[0], x[1], raw[cuts[1]:]), raw[:cuts[1]])


def place_inside(chunk: int) -> int:
    """Sort key of the text closed inside a chunk."""
    return 2 * chunk + 1


def place_before(chunk: int) -> int:
    """Sort key of the text closed at the seam in front of a chunk."""
    return 2 * chunk


# -- batches ------------------------------------------------------------------

class Batch:
    """Texts that share a dictionary of units, up to ``limit`` bytes; a unit is
    aligned once, when the batch is closed."""

    def __init__(self, aligner: Aligner, limit: int):
        self.aligner, self.limit = aligner, limit
        self.index: defaultdict[str, int] = defaultdict()      # a new unit gets the next number
        self.index.default_factory = self.index.__len__
        self.rows: list[tuple] = []         # row, doc_id, place
        self.units: list[np.ndarray] = []   # numbers of each text's units, in order
        self.bytes = 0

    def add(self, row: int, doc_id, place: int | None, spaced: str) -> None:
        """A whole text (``place`` None) or the part of one at ``place``;
        empty for a text without tokens."""
        units = units_of(spaced) if spaced else []
        self.rows.append((row, doc_id, place))
        self.units.append(np.fromiter(map(self.index.__getitem__, units), np.int32, len(units)))
        self.bytes += len(spaced) + 64

    def full(self) -> bool:
        return self.bytes >= self.limit or len(self.index) >= BATCH_UNITS

    def close(self, name: int) -> dict:
        """The batch as one row: its id pairs, in how many whole documents each
        is linked, the pairs of each part's document, and the rest packed.  A
        text's hash stands for the groups of a whole text; parts keep them."""
        known = self.aligner.align(list(self.index))
        size = max(len(self.index), 1)
        key, times = np.unique(np.repeat(np.arange(len(self.units)), [len(u) for u in self.units]) * size
                               + np.concatenate(self.units), return_counts=True)
        text, used = key // size, key % size
        spoiled = np.zeros(len(self.units), bool)
        spoiled[text[~known.good[used]]] = True
        kept = ~spoiled[text]
        text, used, times = text[kept], used[kept], times[kept]
        texts = []
        for (_, _, place), at, bad in zip(self.rows, self.units, spoiled.tolist()):
            groups = b"" if bad else b";".join([known.texts[i] for i in at.tolist()])
            texts.append(hashlib.sha256(groups).hexdigest().encode() if place is None and groups else groups)
        pairs, flat = np.unique(known.links, return_inverse=True)
        docs = np.zeros(len(pairs), np.int64)
        of_row, of_pair = [], []
        whole = np.array([place is None for _, _, place in self.rows], bool)
        numbers = np.array([row for row, _, _ in self.rows], np.int64)
        for t, held in _held(text, used, known.ptr, flat, len(pairs)):
            docs += np.bincount(held[whole[t]], minlength=len(pairs))
            of_row.append(numbers[t[~whole[t]]])
            of_pair.append(pairs[held[~whole[t]]])
        ends = np.searchsorted(text, np.arange(len(self.units) + 1))
        cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)                    # noqa: E731
        packed = _pack(ptr=known.ptr, flat=flat.astype(np.int32), figures=known.figures[:, :3], ends=ends,
                       used=used.astype(np.int32), times=times.astype(np.int32))
        rows, doc_ids, places = zip(*self.rows)
        return {"batch": name, "packed": packed, "pairs": pairs, "pair_docs": docs,
                "part_rows": cat(of_row), "part_pairs": cat(of_pair),
                "rows": rows, "doc_ids": doc_ids, "places": places, "good": (~spoiled).tolist(), "texts": texts}


def _held(text: np.ndarray, units: np.ndarray, ptr: np.ndarray, flat: np.ndarray, pairs: int, some: int = 500_000):
    """(text, pair) of every pair that a text holds, once each, some texts at a
    time: the pairs of its units, gathered and made distinct."""
    at = 0
    while at < len(text) and pairs:
        end = min(at + some, len(text))
        end = int(np.searchsorted(text, text[end - 1], "right"))
        u = units[at:end]
        count = ptr[u + 1] - ptr[u]
        first = np.repeat(ptr[u] - (np.cumsum(count) - count), count)
        key = np.sort(np.repeat(text[at:end], count) * pairs + flat[first + np.arange(len(first))])
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        yield key // pairs, key % pairs
        at = end


def _pack(**arrays) -> bytes:
    buf = io.BytesIO()
    np.savez(buf, **arrays)
    raw = buf.getvalue()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes):
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.load(io.BytesIO(raw))


_BATCH = pa.schema([("batch", pa.int64()), ("packed", pa.binary()), ("pairs", pa.list_(pa.int64())),
                    ("pair_docs", pa.list_(pa.int64())), ("part_rows", pa.list_(pa.int64())),
                    ("part_pairs", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())),
                    ("doc_ids", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("good", pa.list_(pa.bool_())),
                    ("texts", pa.list_(pa.binary()))])
_CHUNK = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("raw", pa.binary())])
_BATCH_DDL = ("batch long, packed binary, pairs array<long>, pair_docs array<long>, part_rows array<long>, "
              "part_pairs array<long>, rows array<long>, doc_ids array<long>, places array<long>, good array<boolean>, "
              "texts array<binary>")
_CHUNK_DDL = "row long, doc_id long, chunk long, raw binary"


def _one(fields: pa.Schema, values: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in fields], schema=fields)


def _names(stage: int) -> Iterator[int]:
    """Numbers that no other task of the same pass gives; ``stage`` tells the
    two passes apart."""
    first = (TaskContext.get().partitionId() << 32) + (stage << 62)
    return iter(range(first, first + (1 << 32)))


# -- the operator -------------------------------------------------------------

class Alignment:
    """What :func:`align` returns: ``documents`` (one row per row of the
    input), ``parts`` (the groups of long documents, part by part, in order of
    ``place``) and ``pairs`` (``a, b, docs``: in how many documents the two ids
    are linked, and whether that is the most of ``a``)."""

    def __init__(self, documents: DataFrame, parts: DataFrame, pairs: DataFrame):
        self.documents, self.parts, self.pairs = documents, parts, pairs


def align(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES,
          batch_bytes: int = BATCH_BYTES) -> Alignment:
    """Align tokens of A (byte-level BPE, JSON file) and B (sentence pieces).

    ``documents``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``.  Null and empty texts, and texts whose tokens' bytes are
    not ``space + text`` (in A or in B), have no tokens: zeros and ''.  Repeated
    rows and ids are rows and documents of their own, a null doc_id passes
    through, other columns are ignored, an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    with open(b_path, "rb") as f:
        files = sc.broadcast((read_spec(a_path), f.read()))

    def first_pass(batches):
        """Documents of one chunk are aligned here; longer ones leave as chunks."""
        aligner, names, rows = _aligner(*files.value), _names(0), _names(0)
        batch = Batch(aligner, batch_bytes)
        fields = pa.schema([*_BATCH, *_CHUNK])
        for ids, texts in columns_of(batches):
            for doc_id, text in zip(ids, texts):
                row = next(rows)
                spaced = " " + text if text else ""
                raw = text_bytes(spaced) if len(spaced) > chunk_bytes // 4 else b""
                if len(raw) > chunk_bytes:
                    for k, at in enumerate(range(0, len(raw), chunk_bytes)):
                        yield _one(fields, {"row": row, "doc_id": doc_id, "chunk": k, "raw": raw[at:at + chunk_bytes]})
                    continue
                batch.add(row, doc_id, None, spaced)
                if batch.full():
                    yield _one(fields, batch.close(next(names)))
                    batch = Batch(aligner, batch_bytes)
        if batch.rows:
            yield _one(fields, batch.close(next(names)))

    def part_pass(batches):
        """Closed text of long documents, wherever in them it lies."""
        aligner, names = _aligner(*files.value), _names(1)
        batch = Batch(aligner, batch_bytes)
        for cols in columns_of(batches):
            for row, doc_id, place, raw in zip(*cols):
                batch.add(row, doc_id, place, raw.decode("utf-8", "surrogatepass"))
                if batch.full():
                    yield _one(_BATCH, batch.close(next(names)))
                    batch = Batch(aligner, batch_bytes)
        if batch.rows:
            yield _one(_BATCH, batch.close(next(names)))

    first = cut_lineage(doc_columns(docs).mapInArrow(first_pass, f"{_BATCH_DDL}, {_CHUNK_DDL}"))
    columns = [f.name for f in _BATCH]
    whole = first.filter("packed IS NOT NULL").select(*columns)
    closed = closed_text(first.filter("raw IS NOT NULL").select("row", "doc_id", "chunk", "raw"))
    parted = cut_lineage(closed.repartition("row", "place").mapInArrow(part_pass, _BATCH_DDL))
    batches = whole.unionByName(parted)
    pairs = pair_counts(whole, parted)
    looked = (batches.select("batch", F.posexplode("pairs").alias("i", "pair"))
              .join(pairs.select("pair", "docs", "best"), "pair")
              .groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("i", "docs", "best"))).alias("x"))
              .select("batch", F.col("x.docs").alias("docs"), F.col("x.best").alias("best")))
    rows = cut_lineage(batches.select("batch", "packed", "rows", "doc_ids", "places", "good", "texts")
                       .join(looked, "batch", "left").drop("batch").mapInArrow(_figures, _ROW_DDL))
    parts = rows.filter("place IS NOT NULL")
    folded = parts.repartition("row").sortWithinPartitions("row", "place").mapInArrow(_fold_parts, _ROW_DDL)
    done = rows.filter("place IS NULL").unionByName(folded)
    documents = done.select("doc_id", *FIGURES, F.col("text").cast("string").alias("groups_sha256"))
    return Alignment(documents, parts.select("row", "doc_id", "place", F.col("text").cast("string").alias("groups")),
                     pairs.filter("docs > 0").select(
                         F.shiftright("pair", B_BITS).alias("a"),
                         F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"), "docs", "best"))


def closed_text(chunks: DataFrame) -> DataFrame:
    """``row, doc_id, place, raw`` of all text of chunked documents, closed by
    a tree of compositions: ``ARITY`` neighbouring fragments of a document
    become one at every level, until each document is one fragment."""
    ddl = "row long, doc_id long, at long, first long, prefix binary, suffix binary, place long, raw binary"
    fields = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("first", pa.int64()),
                        ("prefix", pa.binary()), ("suffix", pa.binary()), ("place", pa.int64()), ("raw", pa.binary())])

    def rows_out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    def leaves(batches):
        for cols in columns_of(batches):
            for row, doc_id, k, raw in zip(*cols):
                (first, prefix, suffix), inside = fragment(k, raw)
                out = [(row, doc_id, k, first, prefix, suffix, None, None)]
                if inside:
                    out.append((row, doc_id, None, None, None, None, place_inside(k), inside))
                yield rows_out(out)

    def composed(table: pa.Table) -> pa.Table:
        got = sorted(zip(*[table[c].to_pylist() for c in ("first", "prefix", "suffix")]))
        row, doc_id, up = table["row"][0].as_py(), table["doc_id"][0].as_py(), table["up"][0].as_py()
        x, out = got[0], []
        for y in got[1:]:
            seam = place_before(y[0])
            x, shut = compose(x, y)
            if shut:
                out.append((row, doc_id, None, None, None, None, seam, shut))
        out.append((row, doc_id, up, *x, None, None))
        return pa.Table.from_batches([rows_out(out)])

    nodes = cut_lineage(chunks.repartition("row", "chunk").mapInArrow(leaves, ddl))
    closed = [nodes.filter("raw IS NOT NULL")]
    top = nodes.filter("prefix IS NOT NULL")
    ends = chunks.groupBy("row").agg((F.max("chunk") + 1).alias("chunks"))
    while top.filter(F.col("at") > 0).limit(1).count():
        nodes = cut_lineage(top.withColumn("up", F.floor(F.col("at") / ARITY))
                            .groupBy("row", "up").applyInArrow(composed, ddl))
        closed.append(nodes.filter("raw IS NOT NULL"))
        top = nodes.filter("prefix IS NOT NULL")
    # the two ends of a document are ends of tokens
    root = top.join(ends, "row").select(
        "row", "doc_id", F.explode(F.array(
            F.struct(F.lit(0).cast("long").alias("place"), F.col("prefix").alias("raw")),
            F.struct((2 * F.col("chunks")).alias("place"), F.col("suffix").alias("raw")))).alias("x")) \
        .select("row", "doc_id", "x.place", "x.raw").filter("raw IS NOT NULL")
    out = root
    for c in closed:
        out = out.unionByName(c.select("row", "doc_id", "place", "raw"))
    return out


def pair_counts(whole: DataFrame, parted: DataFrame) -> DataFrame:
    """``pair, docs, best`` (whether no other pair of the same A id is in more
    documents).  Batches bring counts of whole documents; the parts of a long
    document bring its pairs, which are made distinct.  A document with a part
    that has no tokens has none at all.  An A id has at most as many pairs as
    B has pieces."""
    exploded = whole.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("x")) \
        .select(F.col("x.pairs").alias("pair"), F.col("x.pair_docs").alias("n"))
    held = parted.select(F.explode(F.arrays_zip("part_rows", "part_pairs")).alias("x")) \
        .select(F.col("x.part_rows").alias("row"), F.col("x.part_pairs").alias("pair")).distinct()
    bad = parted.select(F.explode(F.arrays_zip("rows", "good")).alias("x")).filter("NOT x.good") \
        .select(F.col("x.rows").alias("row")).distinct()
    counted = held.join(bad, "row", "left_anti").select("pair", F.lit(1).cast("long").alias("n"))
    per_a = Window.partitionBy(F.shiftright("pair", B_BITS))
    pairs = exploded.unionByName(counted).groupBy("pair").agg(F.sum("n").alias("docs"))
    return cut_lineage(pairs.withColumn("best", F.col("docs") == F.max("docs").over(per_a)))


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_ROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("good", pa.bool_()),
                  *[(c, pa.int64()) for c in FIGURES], ("text", pa.binary())])
_ROW_DDL = "row long, doc_id long, place long, good boolean, " + ", ".join(f"{c} long" for c in FIGURES) + ", text binary"


def _figures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of every text of a batch: the counts of its pairs are summed
    per unit, then per text over its units."""
    def running(x):
        return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])

    for rb in batches:
        for r in range(rb.num_rows):
            v = {n: rb.column(i)[r] for i, n in enumerate(rb.schema.names)}
            z = _unpack(v["packed"].as_py())
            ptr, flat, ends, used, times = z["ptr"], z["flat"], z["ends"], z["used"], z["times"].astype(np.int64)
            if len(flat):
                docs = v["docs"].values.to_numpy(zero_copy_only=False)
                best = v["best"].values.to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                docs = best = np.zeros(0, np.int64)
            per_unit = [*z["figures"].T, np.diff(ptr)]
            for x in (best, docs):
                total = running(x[flat])
                per_unit.append(total[ptr[1:]] - total[ptr[:-1]])
            per_text = []
            for x in per_unit:
                total = running(x[used] * times)
                per_text.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([v["rows"].values, v["doc_ids"].values, v["places"].values,
                                              v["good"].values, *per_text, v["texts"].values], schema=_ROW)


def _fold_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order of (row, place) to one row per document: sums, and the
    hash of the groups read as a stream."""
    now = None

    def closed():
        row, doc_id, good, sums, h, n = now
        some = good and n
        return (row, doc_id, None, True, *(sums if some else [0] * len(FIGURES)),
                h.hexdigest().encode() if some else b"")

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)

    for cols in columns_of(batches):
        out = []
        for row, doc_id, _, good, *figures, text in zip(*cols):
            if now is None or now[0] != row:
                if now is not None:
                    out.append(closed())
                now = [row, doc_id, True, [0] * len(FIGURES), hashlib.sha256(), 0]
            now[2] = now[2] and good
            now[3] = [a + b for a, b in zip(now[3], figures)]
            if text:
                now[4].update((b";" if now[5] else b"") + text)
                now[5] += 1
        if out:
            yield as_batch(out)
    if now is not None:
        yield as_batch([closed()])
