"""Suffix-array dedup by difference-cover blockwise construction (operator 10).

Removes each byte covered by a string of SPAN bytes that also starts in a
document with a smaller doc_id.

A suffix matters here by its first SPAN bytes, its *window*.  Suffixes are
dealt into buckets so that equal windows meet: every window picks its anchor,
the k-gram in it with the least hash, and goes where the anchor's hash sends
it.  An anchor stands for a run of adjacent windows (16 on average), which
travel as one string of bytes.  Buckets are sorted one at a time, in bounded
memory: windows are aligned at their anchor, the columns that fall in a
difference cover modulo 7 are the *sample*, their long prefixes are ranked
first, and every other suffix is sorted by its few bytes before and after the
next sample column and by that column's rank, never by whole windows.  (As
equal anchors align equal columns, two windows are only ever compared at the
same offset; of the difference cover only its density matters here: no column
is far before a sample column.)  In each class of equal windows the smallest doc_id keeps its copy.

Three rounds over the documents, which are shuffled once (by *epoch*, a bounded
group of documents) and read again from that exchange:

1. per epoch, the distinct anchors; a bucket finds those of several documents,
2. per epoch, the runs of shared anchors; a bucket sorts their suffixes,
3. per epoch, the bytes covered by windows found in smaller documents go.

Anchors with over HOT_RUNS runs (a passage in a large share of all documents)
send every window on its own, once per epoch, to the bucket of the window's
own hash, so no bucket gets more than one row per epoch and window of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, text_bytes

SPAN = 50
GRAM = 20
#: A difference cover modulo 7: every difference occurs between two of these,
#: and no column is more than 3 before a sample column.
COVER_MOD, COVER = 7, (0, 1, 3)
REACH = 3
EPOCHS_PER_PARTITION = 2
BUCKETS_PER_PARTITION = 1
HOT_RUNS = 2_000
BATCH_BYTES = 2_000_000
PART_BYTES = 1 << 23
PART_ROWS = 1 << 15         # records of a bucket that are sorted at once
BASE = 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1        # stands for a null doc_id: larger than any


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _spread(x: np.ndarray) -> np.ndarray:
    """32-bit integers in a random order, the same everywhere."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def rolling(text: np.ndarray, length: int) -> np.ndarray:
    """32-bit hash of every string of ``length`` bytes: powers of two by
    doubling.  It only chooses among neighbours; keys are :func:`gram_keys`."""
    level, size = text.astype(np.uint32) + np.uint32(1), 1
    out, done = None, 0
    while True:
        power = np.uint32(pow(BASE, size, 1 << 32))
        if length & size:
            part = level[done:]
            if out is None:
                out = part
            else:
                n = min(len(out), len(part))
                out = out[:n] * power
                out += part[:n]
            done += size
        if done == length:
            return _spread(out if out.base is None else out.copy())
        if len(level) > size:
            next_level = level[:-size] * power
            next_level += level[size:]
            level = next_level
        else:
            level = level[:0]
        size *= 2


def gram_keys(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the k-grams at some places."""
    key = np.zeros(len(at), np.uint64)
    for i in range(GRAM):
        key *= np.uint64(BASE)
        key += text[at + i]
        key += np.uint64(1)
    return _mix(key)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class Runs:
    """The anchor runs of one document batch, as arrays: ``key`` (the anchor's
    hash), ``doc`` (index into the epoch), ``start`` (first window, in the
    batch's bytes), ``windows`` (their number), ``left`` (anchor - start)."""

    def __init__(self, texts: list[bytes], first_doc: int):
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        self.first_doc = first_doc
        empty = np.zeros(0, np.int64)
        self.key, self.doc, self.start, self.windows, self.left = empty.astype(np.uint64), empty, empty, empty, empty
        if len(self.bytes) < SPAN:
            return
        gram = rolling(self.bytes, GRAM)
        # least hash, then leftmost
        ranked = gram.astype(np.uint64)
        ranked <<= np.uint64(32)
        ranked |= np.arange(len(gram), dtype=np.uint64)
        least = sliding_min(ranked, SPAN - GRAM + 1)
        valid = np.zeros(len(self.bytes) + 1, np.int8)
        np.add.at(valid, self.begins[lengths >= SPAN], 1)
        np.add.at(valid, self.ends[lengths >= SPAN] - SPAN + 1, -1)
        valid = np.cumsum(valid[:len(least)], dtype=np.int8).view(bool)
        # a run ends where the anchor, or the document, changes
        anchor = np.ascontiguousarray(least.astype("<u8", copy=False).view("<u4")[::2])
        edge = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])])
        held = valid[edge]
        self.start = edge[held]
        if not len(self.start):
            return
        self.windows = np.diff(np.r_[edge, len(valid)])[held]
        anchor = anchor[self.start].astype(np.int64)
        self.left = anchor - self.start
        self.key = gram_keys(self.bytes, anchor)
        self.doc = np.searchsorted(self.ends, self.start, side="right") + first_doc


def batches_of(docs: list[tuple[int, bytes]], batch_bytes: int = BATCH_BYTES):
    """Runs of an epoch's documents, in bounded batches."""
    first, held, size = 0, [], 0
    for i, (_, t) in enumerate(docs):
        held.append(t)
        size += len(t)
        if size >= batch_bytes:
            yield from _split_long(held, first)
            first, held, size = i + 1, [], 0
    if held:
        yield from _split_long(held, first)


def _split_long(texts, first):
    """A batch has a bounded number of bytes; a longer text goes in overlapping
    parts (every window is in exactly one)."""
    limit = PART_BYTES
    if sum(map(len, texts)) <= limit:
        yield Runs(texts, first), 0
        return
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - SPAN + 1), limit):
            yield Runs([t[at:at + limit + SPAN - 1]], first + i), at


def epoch_docs(table: pa.Table) -> list[tuple[int, bytes]]:
    """``(doc order, text)`` of an epoch, in an order that doesn't depend on
    how its rows arrived."""
    ids = [LAST if d is None else d for d in table.column("doc_id").to_pylist()]
    return sorted(zip(ids, map(text_bytes, table.column("text").to_pylist())))


def _planes(x: np.ndarray) -> bytes:
    """Sorted integers byte plane by byte plane, which compresses."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(">u8").reshape(-1).astype(np.uint64)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(key ^ np.uint64(0xA5A5A5A5)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(buckets: np.ndarray, *arrays):
    """Arrays of each bucket, in the order they had."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    sorted_buckets = buckets[order]
    cuts = np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
        pick = order[a:b]
        yield int(sorted_buckets[a]), *(x[pick] for x in arrays)


def _pieces(text: np.ndarray, start: np.ndarray, lengths: np.ndarray, some: int = 1 << 13) -> np.ndarray:
    """Strings of ``text`` one after another; indices (8 bytes a byte) exist
    for ``some`` of them at a time."""
    out, at = np.empty(int(lengths.sum()), np.uint8), 0
    for a in range(0, len(start), some):
        n = lengths[a:a + some]
        end = at + int(n.sum())
        out[at:end] = text[np.repeat(start[a:a + some] - (np.cumsum(n) - n), n) + np.arange(end - at)]
        at = end
    return out


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    cols = zip(*rows) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


# -- round 1: shared anchors ------------------------------------------------

ANCHORS = pa.schema([("bucket", pa.int64()), ("epoch", pa.int64()), ("keys", pa.binary()), ("seen", pa.binary())])
SHARED = pa.schema([("epoch", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("marks", pa.binary())])


def epoch_anchors(docs: list[tuple[int, bytes]], epoch: int, buckets: int) -> list[tuple]:
    """Distinct anchors of an epoch by bucket; ``seen``: runs (at most 127),
    plus 128 where several of the epoch's documents have it."""
    keys, owner = [], []
    order = np.array([d for d, _ in docs], np.int64)
    for runs, _ in batches_of(docs):
        keys.append(runs.key)
        owner.append(order[runs.doc])
    if not keys:
        return []
    key, doc = np.concatenate(keys), np.concatenate(owner)
    by = np.lexsort((doc, key))
    key, doc = key[by], doc[by]
    if not len(key):
        return []
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    last = np.r_[first[1:], len(key)] - 1
    seen = np.minimum(last - first + 1, 127) + 128 * (doc[first] != doc[last])
    key = key[first]
    return [(b, epoch, _planes(k), s.astype(np.uint8).tobytes()) for b, k, s in _by_bucket(_bucket(key, buckets), key, seen)]


def shared_anchors(table: pa.Table, hot_runs: int = HOT_RUNS) -> list[tuple]:
    """Of a bucket's anchors, those of several documents: back to each epoch
    that has them, with a mark where the anchor is hot."""
    epochs = table.column("epoch").to_numpy()
    keys = [_from_planes(k) for k in table.column("keys").to_pylist()]
    key = np.concatenate(keys)
    seen = np.frombuffer(b"".join(table.column("seen").to_pylist()), np.uint8)
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    by = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
    group = np.zeros(len(key), np.int64)
    group[by] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
    shared = np.maximum(np.bincount(group) > 1, np.bincount(group, seen >= 128) > 0)
    # runs counted up to 127 an epoch
    hot = np.bincount(group, seen & 127) > hot_runs
    pick = np.flatnonzero(shared[group])
    return [(int(epochs[r]), 0, _planes(k), h.astype(np.uint8).tobytes())
            for r, k, h in _by_bucket(row[pick], key[pick], hot[group[pick]])]


# -- round 2: suffixes of shared anchors --------------------------------------

SUFFIXES = pa.schema([("bucket", pa.int64()), ("epoch", pa.int64()), ("record", pa.binary()), ("doc", pa.binary()),
                      ("left", pa.binary()), ("windows", pa.binary()), ("text", pa.binary())])


def shared_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """An epoch's shared anchors (sorted) and whether each is hot."""
    kind = table.column("kind").to_pylist()
    rows = [(k, m) for x, k, m in zip(kind, table.column("keys").to_pylist(), table.column("marks").to_pylist()) if x == 0]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    keys = np.concatenate([_from_planes(k) for k, _ in rows])
    hot = np.frombuffer(b"".join(m for _, m in rows), np.uint8) > 0
    by = np.argsort(keys)
    return keys[by], hot[by]


class Records:
    """The records of an epoch, numbered in a reproducible order: first the
    runs of shared anchors that aren't hot, batch by batch, then the distinct
    windows of hot anchors.  ``places`` tells for each record where its windows
    are: ``(record, doc, first window in the document)``."""

    def __init__(self, docs, keys, hot, texts: bool = True):
        """``texts``: whether the records are to be sent (:meth:`rows`)."""
        order = np.array([d for d, _ in docs], np.int64)
        self.parts = []            # (bucket key, doc order, left, windows, text bytes, lengths)
        self.places = []           # (record numbers, doc index, start in doc, windows)
        count, hot_rows = 0, []
        for runs, offset in batches_of(docs):
            if not len(runs.key) or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, runs.key), len(keys) - 1)
            found = keys[at] == runs.key
            in_doc = runs.start - runs.begins[runs.doc - runs.first_doc] + offset
            plain = np.flatnonzero(found & ~hot[at])
            if len(plain):
                if texts:
                    self._add(runs, plain, runs.key[plain], order, runs.start[plain], runs.windows[plain], runs.left[plain])
                self.places.append((np.arange(count, count + len(plain)), runs.doc[plain], in_doc[plain], runs.windows[plain]))
                count += len(plain)
            warm = np.flatnonzero(found & hot[at])
            if len(warm):
                n = runs.windows[warm]
                each = np.repeat(warm, n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = runs.start[each] + step
                grid = runs.bytes[start[:, None] + np.arange(SPAN)]
                hot_rows.append((grid, runs.left[each] - step, runs.doc[each], in_doc[each] + step))
        if hot_rows:
            grid, left, doc, start = (np.concatenate(x) for x in zip(*hot_rows))
            whole = np.ascontiguousarray(grid).view(f"V{SPAN}").reshape(-1)
            _, first, group = np.unique(whole, return_index=True, return_inverse=True)
            group = group.reshape(-1)
            least = np.full(len(first), LAST, np.int64)
            np.minimum.at(least, group, order[doc])
            text = grid[first]
            key = np.array([int.from_bytes(hashlib.blake2b(t.tobytes(), digest_size=8).digest(), "little") for t in text], np.uint64)
            self.parts.append((key, least, left[first], np.ones(len(first), np.int64), text.reshape(-1), np.full(len(first), SPAN)))
            self.places.append((count + group, doc, start, np.ones(len(doc), np.int64)))
            self.least = (count, least)
        else:
            self.least = (count, np.zeros(0, np.int64))

    def _add(self, runs, pick, key, order, start, windows, left):
        lengths = windows + SPAN - 1
        self.parts.append((key, order[runs.doc[pick]], left, windows, _pieces(runs.bytes, start, lengths), lengths))

    def rows(self, epoch: int, buckets: int) -> list[tuple]:
        if not self.parts:
            return []
        key, doc, left, windows, text, lengths = (np.concatenate(x) for x in zip(*self.parts))
        begin = np.cumsum(lengths) - lengths
        out = []
        for b, rec, d, lf, w, at, n in _by_bucket(_bucket(key, buckets), np.arange(len(key)), doc, left, windows, begin, lengths):
            t = _pieces(text, at, n)
            out.append((b, epoch, _planes(rec), _planes(d), lf.astype(np.uint8).tobytes(), w.astype(np.uint8).tobytes(), t.tobytes()))
        return out


def bounded_parts(text, anchors, part_rows: int) -> list[np.ndarray]:
    """Records of a bucket in parts of about ``part_rows``, equal anchors (and
    so equal windows) in one part."""
    parts = -(-len(anchors) // part_rows)
    if parts <= 1:
        return [np.arange(len(anchors))]
    part = _bucket(gram_keys(text, anchors), parts)
    return np.split(np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))[:-1])


def found_before(doc, left, windows, text, part_rows: int = PART_ROWS) -> np.ndarray:
    """For each record of a bucket a mask of the windows (bit by bit from its
    first) that a smaller document has too; sorted part by part, so that the
    work arrays don't grow with the bucket."""
    lengths = windows + SPAN - 1
    begin = np.cumsum(lengths) - lengths
    masks = np.zeros(len(doc), np.uint64)
    for pick in bounded_parts(text, begin + left, part_rows):
        masks[pick] = _sorted_part(doc[pick], left[pick], windows[pick], text, begin[pick])
    return masks


def _sorted_part(doc, left, windows, text, begin) -> np.ndarray:
    """Sort the suffixes of some records, whose bytes begin at ``begin``.

    Records are aligned at their anchor.  Columns of the difference cover are
    ranked by their first SPAN - REACH bytes; a window is then its next sample
    column's rank with the REACH bytes that lie outside, one integer."""
    most = SPAN - GRAM
    width = most + SPAN + 8
    lengths = windows + SPAN - 1
    rows = len(doc)
    grid = np.zeros((rows, width), np.uint8)
    shift = most - left                                     # column of a record's first byte
    for j in range(int(lengths.max(initial=0))):
        has = np.flatnonzero(lengths > j)
        grid[has, shift[has] + j] = text[begin[has] + j]
    masks = np.zeros(rows, np.uint64)
    long = SPAN - REACH
    column, ranks = -1, None
    for o in range(most + 1):
        live = np.flatnonzero((shift <= o) & (o < shift + windows))
        if not len(live):
            continue
        c = next(c for c in range(o, o + REACH + 1) if (c % COVER_MOD) in COVER)
        if c != column:                                     # rank the sample column
            column = c
            need = np.flatnonzero((shift <= c) & (c + long <= shift + lengths))
            words = np.zeros((len(need), 48), np.uint8)
            words[:, :long] = grid[need, c:c + long]
            words = words.view(">u8").astype(np.uint64)
            by = np.lexsort(words.T[::-1])
            new = np.zeros(len(by), bool)
            for w in words.T:
                w = w[by]
                new[1:] |= w[1:] != w[:-1]
            ranks = np.zeros(rows, np.uint64)
            ranks[need[by]] = np.cumsum(new).astype(np.uint64)
        outside = np.concatenate([np.arange(o, c), np.arange(c + long, o + SPAN)])
        extra = grid[live][:, outside].astype(np.uint64) @ np.array([1, 256, 65536], np.uint64)
        key = (ranks[live] << np.uint64(24)) | extra
        by = np.lexsort((doc[live], key))
        sorted_key, sorted_doc = key[by], doc[live][by]
        first = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
        least = np.repeat(sorted_doc[first], np.diff(np.r_[first, len(by)]))
        again = live[by[sorted_doc > least]]
        masks[again] |= np.uint64(1) << (o - shift[again]).astype(np.uint64)
    return masks


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all values of a binary column, one after another."""
    parts = [np.zeros(0, np.uint8)]
    for c in column.cast(pa.binary()).chunks:
        ends = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset) if len(c) else (0, 0)
        if ends[-1] > ends[0]:
            parts.append(np.frombuffer(c.buffers()[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0])))
    return np.concatenate(parts)


def sorted_bucket(table: pa.Table) -> list[tuple]:
    """A bucket's records back to their epochs, with the masks found."""
    join = lambda c, kind: _joined(table.column(c)).view(kind)
    records = [_from_planes(r) for r in table.column("record").to_pylist()]
    doc = np.concatenate([_from_planes(d) for d in table.column("doc").to_pylist()]).view(np.int64)
    masks = found_before(doc, join("left", np.uint8).astype(np.int64), join("windows", np.uint8).astype(np.int64),
                         join("text", np.uint8))
    out, at = [], 0
    for epoch, rec in zip(table.column("epoch").to_pylist(), records):
        m = masks[at:at + len(rec)]
        at += len(rec)
        hit = np.flatnonzero(m)
        if len(hit):
            out.append((epoch, 1, _planes(rec[hit]), m[hit].astype("<u8").tobytes()))
    return out


# -- round 3: cut ------------------------------------------------------------

CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                 ("kept", pa.binary())])


def cut_epoch(docs, replies: pa.Table):
    """``(doc order, bytes, removed mask)`` of an epoch's documents."""
    records = Records(docs, *shared_keys(replies), texts=False)
    kind = replies.column("kind").to_pylist()
    rows = [(r, m) for x, r, m in zip(kind, replies.column("keys").to_pylist(), replies.column("marks").to_pylist()) if x == 1]
    first_hot, least = records.least
    masks = np.zeros(first_hot + len(least), np.uint64)
    for r, m in rows:
        masks[_from_planes(r).astype(np.int64)] = np.frombuffer(m, "<u8")
    order = np.array([d for d, _ in docs], np.int64)
    spans = [(np.zeros(0, np.int64),) * 3]                  # doc index, begin and end of windows in a row
    for rec, d, s, n in records.places:
        each = np.repeat(np.arange(len(rec)), n)
        step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        found = (masks[rec[each]] >> step.astype(np.uint64)) & np.uint64(1) > 0
        hot = rec >= first_hot
        if hot.any():                                       # others of the epoch have it after its least document
            found |= order[d[each]] > least[rec[each] - first_hot]
        at = np.flatnonzero(found)
        if len(at):
            doc, start = d[each[at]], s[each[at]] + step[at]
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
            spans.append((doc[new], start[new], start[np.r_[new[1:] - 1, len(at) - 1]] + SPAN))
    doc, begin, end = (np.concatenate(x) for x in zip(*spans))
    by = np.lexsort((begin, doc))
    doc, begin, end = doc[by], begin[by], end[by]
    bounds = np.searchsorted(doc, np.arange(len(docs) + 1)).tolist()
    begin, end = begin.tolist(), end.tolist()
    for i, (d, t) in enumerate(docs):
        gone = np.zeros(len(t), bool)
        for x in range(bounds[i], bounds[i + 1]):
            gone[begin[x]:end[x]] = True
        yield d, t, gone


def cut_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   hot_runs: int = HOT_RUNS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans long, kept binary`` per row.

    Strings are judged on the input and never cross documents.  A null text is
    empty; texts of under SPAN bytes stay whole; a null doc_id counts as larger
    than any other, and rows of equal doc_id (or none) don't remove each
    other's bytes; an empty table gives no rows; other columns are ignored.
    """
    parts = shuffle_width(docs)
    epochs, buckets = parts * EPOCHS_PER_PARTITION, parts * BUCKETS_PER_PARTITION
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    dealt = (docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
             .withColumn("epoch", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.left("text", F.lit(64))),
                                         F.lit(epochs)).cast("long"))
             .repartition(parts, "epoch"))

    def round_1(key, table):
        return _table(ANCHORS, epoch_anchors(epoch_docs(table), key[0].as_py(), buckets))

    def bucket_1(key, table):
        return _table(SHARED, shared_anchors(table, hot_runs))

    def round_2(key, left, right):
        docs_ = epoch_docs(left)
        return _table(SUFFIXES, Records(docs_, *shared_keys(right)).rows(key[0].as_py(), buckets) if docs_ else [])

    def bucket_2(key, table):
        return _table(SHARED, sorted_bucket(table))

    def round_3(key, left, right):
        rows = []
        for d, t, gone in cut_epoch(epoch_docs(left), right):
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((None if d == LAST else d, len(t), int(gone.sum()), spans, kept))
        return _table(CUT, rows)

    reply = "epoch long, kind int, keys binary, marks binary"
    shared = (dealt.groupBy("epoch").applyInArrow(round_1, "bucket long, epoch long, keys binary, seen binary")
              .groupBy("bucket").applyInArrow(bucket_1, reply))
    judged = (dealt.groupBy("epoch").cogroup(shared.groupBy("epoch"))
              .applyInArrow(round_2, "bucket long, epoch long, record binary, doc binary, left binary, windows binary, text binary")
              .groupBy("bucket").applyInArrow(bucket_2, reply))
    return (dealt.groupBy("epoch").cogroup(shared.unionByName(judged).groupBy("epoch"))
            .applyInArrow(round_3, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))
