"""Hierarchical multi-length packing (operator 9).

Documents become token ids (with an end mark) and are packed into sequences of
a few context sizes, the *tiers* (powers of two, so that a full sequence of any
tier needs no padding):

1. *route*: whole windows of the longest tier are cut off a document; the rest
   goes to the smallest tier that holds it,
2. *pack* each tier from long to short: its documents open the windows,
3. *fill* the gap of a window from shorter tiers, the longest document that
   fits first; what then is still free is filled by cutting a document of a
   shorter tier, whose rest is routed anew,
4. what remains after the last tier (less than one shortest window) of every
   task meets in a second round, again packed by the same rules,
5. *balance*: the sequences of a round are dealt to step groups, longest first
   to the group with the fewest tokens, so that steps cost alike.

A task packs *blocks*: consecutive documents of a partition up to a number of
tokens.  Memory is bounded by one block, and the first round needs no shuffle;
only the tails (fewer tokens per task than one shortest window) are moved.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_spec
from .bulk_words import blocks, encoder_of
from .common import cut_lineage, doc_columns

TIERS = (256, 512, 1024, 2048, 4096)
EOS_ID = 2
BLOCK_TOKENS = 2_000_000    # ids held by a task at a time (4 bytes each)
STEP_TOKENS = 65_536        # tokens of a step group, padding included
TASKS_PER_TAIL_GROUP = 2_000

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "`offset` long, tier int, step_id long, padded_length int")
_TYPES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
          ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()),
          ("step_id", pa.int64()), ("padded_length", pa.int32())]
#: A tail: a piece that found no full window; it carries its ids.
_TAIL = [("tail", pa.binary()), ("task", pa.int64())]
#: Sequence numbers: task in the high bits; tasks of the second round follow.
TASK_SHIFT = 32
SECOND_ROUND = 1 << 61


class Piece:
    """Tokens ``[start, start + length)`` of a document."""

    __slots__ = ("doc", "start", "length")

    def __init__(self, doc: int, start: int, length: int):
        self.doc, self.start, self.length = doc, start, length


class Shelves:
    """Routed pieces: per tier, lists by length in ascending order."""

    def __init__(self, tiers):
        self.tiers = tiers
        self.by_length: list[dict[int, list[Piece]]] = [{} for _ in tiers]
        self.lengths: list[list[int]] = [[] for _ in tiers]

    def route(self, piece: Piece) -> None:
        t = bisect.bisect_left(self.tiers, piece.length)
        held = self.by_length[t]
        if piece.length not in held:
            held[piece.length] = []
            bisect.insort(self.lengths[t], piece.length)
        held[piece.length].append(piece)

    def longest(self, t: int, most: int) -> Piece | None:
        """Take the longest piece of tier ``t`` of at most ``most`` tokens."""
        i = bisect.bisect_right(self.lengths[t], most) - 1
        if i < 0:
            return None
        length = self.lengths[t][i]
        held = self.by_length[t][length]
        piece = held.pop()
        if not held:
            del self.by_length[t][length]
            self.lengths[t].pop(i)
        return piece


def pack(lengths: list[int], tiers=TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Pack documents of the given token counts: full windows as
    ``(tier, pieces)`` and the tail, pieces of fewer tokens in all than the
    shortest tier.  Every token is in exactly one piece."""
    longest = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    shelves = Shelves(tiers)
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= longest:
            windows.append((longest, [Piece(d, start, longest)]))
            start += longest
        if n > start:
            shelves.route(Piece(d, start, n - start))
    for t in range(len(tiers) - 1, -1, -1):
        size = tiers[t]
        while (piece := shelves.longest(t, size)) is not None:
            held, gap = [piece], size - piece.length
            lower = t
            while gap and lower >= 0:                       # whole pieces, long ones first
                more = shelves.longest(lower, gap)
                if more is None:
                    lower -= 1
                    continue
                held.append(more)
                gap -= more.length
            if gap:                                         # cut one to fit
                more = next((p for s in range(0, t + 1) if (p := shelves.longest(s, size)) is not None), None)
                if more is not None:
                    held.append(Piece(more.doc, more.start, gap))
                    shelves.route(Piece(more.doc, more.start + gap, more.length - gap))
                    gap = 0
            if not gap:
                windows.append((size, held))
            elif t == 0:
                return windows, held
            else:                                           # nothing left to fill it: shorter windows
                used = size - gap
                _split(held, used, tiers[:t], windows, shelves)
    return windows, []


def _split(held, used, tiers, windows, shelves):
    """Cut the pieces of a window that can't be filled into full windows of
    the longest shorter tiers; the remainder is routed again."""
    queue = list(held)
    for size in reversed(tiers):
        while used >= size:
            got, need = [], size
            while need:
                p = queue.pop(0)
                if p.length > need:
                    queue.insert(0, Piece(p.doc, p.start + need, p.length - need))
                    p = Piece(p.doc, p.start, need)
                got.append(p)
                need -= p.length
            windows.append((size, got))
            used -= size
    for p in queue:
        shelves.route(p)


def balance(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step number for each sequence: longest first, to the step that has
    the fewest tokens so far."""
    steps = max(1, -(-sum(sizes) // step_tokens))
    load = [(0, s) for s in range(steps)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        tokens, s = heapq.heappop(load)
        out[i] = s
        heapq.heappush(load, (tokens + sizes[i], s))
    return out


def padded(length: int, longest: int) -> int:
    return length if length & (length - 1) == 0 else longest


class Packer:
    """Packs blocks of documents of one task and numbers their sequences."""

    def __init__(self, first_id: int, tiers, step_tokens):
        self.next_id = self.next_step = first_id
        self.tiers, self.step_tokens = tiers, step_tokens

    def rows(self, docs: list[tuple], last: bool) -> tuple[list[tuple], list[tuple]]:
        """Piece rows, and the tail's documents.  A document is ``(doc_id,
        start of its ids within the whole, ids, doc_tokens)``; with ``last``
        the tail becomes a padded sequence instead."""
        windows, tail = pack([len(ids) // 4 for _, _, ids, _ in docs], self.tiers)
        if last and tail:
            windows.append((self.tiers[-1], tail))
            tail = []
        sizes = [padded(sum(p.length for p in held), self.tiers[-1]) for _, held in windows]
        steps = balance(sizes, self.step_tokens)
        out = []
        for (tier, held), size, step in zip(windows, sizes, steps):
            offset = 0
            for p in held:
                doc_id, begin, ids, n = docs[p.doc]
                crc = zlib.crc32(memoryview(ids)[4 * p.start:4 * (p.start + p.length)])
                out.append((doc_id, begin + p.start, p.length, crc, n, self.next_id, offset, tier,
                            self.next_step + step, size))
                offset += p.length
            self.next_id += 1
        self.next_step += max(steps, default=-1) + 1
        rest = [(docs[p.doc][0], docs[p.doc][1] + p.start, docs[p.doc][2][4 * p.start:4 * (p.start + p.length)],
                 docs[p.doc][3]) for p in tail]
        return out, rest


def _batch(rows, tails, task):
    fields = pa.schema(_TYPES + _TAIL)
    full = [r + (None, task) for r in rows]
    full += [(d, s, len(ids) // 4, None, n, None, None, None, None, None, ids, task) for d, s, ids, n in tails]
    cols = zip(*full) if full else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=fields)


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers=TIERS, eos_id: int = EOS_ID,
                   block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pack every document into sequences of at most ``tiers[-1]`` tokens.

    A document is the ids of its text (null text: none) and ``eos_id``.
    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and ``tier``, ``padded_length`` (the sequence's
    length with padding), ``step_id`` (its step group).  Repeated rows and null
    doc_ids are documents of their own; an empty table gives no rows; other
    columns of ``docs`` are ignored.
    """
    tiers = tuple(tiers)
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are ascending powers of two")
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def first_round(batches) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        task = TaskContext.get().partitionId()
        packer = Packer(task << TASK_SHIFT, tiers, step_tokens)
        end = eos_id.to_bytes(4, "little")
        held, tokens = [], 0
        for rb in batches:
            doc_ids = rb.column(0).to_pylist()
            for at, texts in blocks(rb.column(1)):
                for d, ids in zip(doc_ids[at:], encoder.encode(texts)):
                    ids += end
                    held.append((d, 0, ids, len(ids) // 4))
                    tokens += len(ids) // 4
                    if tokens >= block_tokens:
                        rows, held = packer.rows(held, last=False)
                        tokens = sum(len(ids) // 4 for _, _, ids, _ in held)
                        yield _batch(rows, [], task)
        rows, tails = packer.rows(held, last=False)
        yield _batch(rows, tails, task)

    def second_round(batches) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row in rb.to_pylist():
                packer = Packer(SECOND_ROUND | row["tail_group"] << TASK_SHIFT, tiers, step_tokens)
                docs_ = [(t["doc_id"], t["start"], t["tail"], t["doc_tokens"]) for t in row["tails"]]
                rows, _ = packer.rows(docs_, last=True)
                yield _batch(rows, [], row["tail_group"])

    schema = PIECES + ", tail binary, task long"
    # tails are read beside the packed rows: the round's result is kept, as
    # its task numbers must be those of the sequences
    done = cut_lineage(doc_columns(docs).mapInArrow(first_round, schema))
    columns = [c for c, _ in _TYPES]
    # per task fewer tokens than one shortest window, so a group is bounded
    group = F.floor(F.col("task") / TASKS_PER_TAIL_GROUP).cast("long").alias("tail_group")
    tails = (done.filter("tail is not null")
             .groupBy(group)
             .agg(F.sort_array(F.collect_list(F.struct("task", "doc_id", "start", "tail", "doc_tokens"))).alias("tails")))
    second = tails.mapInArrow(second_round, schema)
    return done.filter("tail is null").select(columns).unionByName(second.select(columns))
