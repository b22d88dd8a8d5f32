"""Chat formatting by minimum-cost role repair (operator 1).

A conversation is legal if an automaton over roles accepts it: perhaps a
system turn first, then user and assistant in alternation, the assistant last.
Every source turn may be kept, relabelled, or merged into the turn before it,
and empty turns may be inserted; dynamic programming over the automaton's
states finds the cheapest legal sequence, which is then rendered.

One step of that program is a matrix of costs between states, and matrices
multiply (minimum of sums) in any grouping.  So a conversation is cut into
fragments of bounded length, each fragment is reduced to one small matrix, the
matrices of a conversation are scanned for the states at which the best path
enters and leaves each fragment, and the fragments are then traced and
rendered on their own.  A conversation of any length spreads over many tasks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, record_batches

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = ("start", "system", "user", "assistant")
#: Legal next roles of each state, and the states a conversation may end in.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (ASSISTANT,)
ALIASES = {"human": USER, "prompter": USER, "bot": ASSISTANT, "ai": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT,
           "developer": SYSTEM, "system": SYSTEM, "user": USER, "assistant": ASSISTANT}
MERGE, INSERT, RELABEL = 1, 2, 3
FRAGMENT_TURNS = 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
NO_ID = -(1 << 63)
INF = 1 << 40


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest inserted turns that make ``to`` a legal next role of a state."""
    out = {}
    for state in range(len(STATES)):
        level, seen = [((), state)], set()
        while level:
            for path, s in level:
                for role in NEXT[s]:
                    out.setdefault((state, role), path)
            level = [((*path, r), r) for path, s in level for r in NEXT[s] if r not in seen and not seen.add(r)]
    return out


INSERTS = _paths()


def role_state(role) -> int | None:
    """State of a role name (aliases, any case); None for unknown or null."""
    return ALIASES.get(role.strip().lower()) if role else None


def step(source: int | None) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """Cheapest way from state to state over one source turn:
    ``(cost, action, roles inserted before it)``."""
    out = {}
    for state in range(len(STATES)):
        for role in (SYSTEM, USER, ASSISTANT):
            relabel = RELABEL * (role != source)
            label = "relabel" if relabel else "keep"
            ways = []
            if state == role:
                ways.append((relabel + MERGE, "relabel and merge" if relabel else "merge", ()))
            if (state, role) in INSERTS:
                path = INSERTS[state, role]
                ways.append((relabel + INSERT * len(path), label, path))
            if ways:
                out[state, role] = min(ways, key=lambda w: w[0])
    return out


STEPS = {source: step(source) for source in (None, SYSTEM, USER, ASSISTANT)}
N = len(STATES)


def _matrix(ways) -> np.ndarray:
    m = np.full((N, N), INF, np.int64)
    for (a, b), (cost, _, _) in ways.items():
        m[a, b] = cost
    return m


MATRICES = {source: _matrix(ways) for source, ways in STEPS.items()}


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None]).min(1), INF)


def end_inserts(state: int) -> tuple[int, ...]:
    """Turns inserted after the last one so that the sequence may end."""
    if state in FINAL:
        return ()
    return min(((*INSERTS[state, f], f) for f in FINAL if (state, f) in INSERTS), key=len)


def fragment_matrix(sources: list[int | None]) -> np.ndarray:
    m = np.where(np.eye(N, dtype=bool), 0, INF).astype(np.int64)
    for s in sources:
        m = product(m, MATRICES[s])
    return m


def scan(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """Entry and exit state of every fragment of one conversation."""
    best = [np.where(np.arange(N) == START, 0, INF)]
    for m in matrices:
        best.append((best[-1][:, None] + m).min(0))
    state = min(range(N), key=lambda s: (best[-1][s] + INSERT * len(end_inserts(s)), s))
    out = []
    for m, before in zip(reversed(matrices), reversed(best[:-1])):
        entry = int((before + m[:, state]).argmin())
        out.append((entry, state))
        state = entry
    return out[::-1]


def trace(sources: list[int | None], entry: int, leave: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """``(role, action, inserted before)`` of every source turn on a cheapest
    path between two states."""
    best = [np.where(np.arange(N) == entry, 0, INF)]
    for s in sources:
        best.append((best[-1][:, None] + MATRICES[s]).min(0))
    out, state = [], leave
    for s, before in zip(reversed(sources), reversed(best[:-1])):
        prior = int((before + MATRICES[s][:, state]).argmin())
        out.append((state, *STEPS[s][prior, state][1:]))
        state = prior
    return out[::-1]


def clean(text) -> str:
    """A text whose own markers can't be taken for the template's."""
    return (text or "").replace("<|im_", "< |im_")


def format_conversations(turns: DataFrame, fragment_turns: int = FRAGMENT_TURNS) -> DataFrame:
    """Repair and render every conversation.

    ``turns``: ``conv_id, turn, role, text``.  Returns one row per source turn
    and inserted turn: ``conv_id, position long, turn, source_role, role,
    action, rendered``; the ``rendered`` texts of a conversation, concatenated
    by position, are its formatted text (a merged turn continues the one
    before it).  Turns are ordered by turn, role and text (nulls first), so
    equal turn numbers and repeated rows are turns of their own; rows without
    conv_id are one conversation; a null or unknown role may become any; a
    null text is empty; an empty table gives no rows; other columns are
    ignored.
    """
    base = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("c"),
                        F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                        F.col("text").cast("string").alias("text"))
    base = base.withColumn("block", F.coalesce(F.floor(F.col("turn") / fragment_turns), F.lit(NO_ID)).cast("long"))
    order = ["c", "block", "turn", "role"]

    def rows_of(batches, columns):
        return (r for rb in batches for r in zip(*(rb.column(n).to_pylist() for n in columns)))

    def cut(group):
        """Fragments of the sorted rows of one block: ``(number, rows)``."""
        for number in itertools.count():
            part = list(itertools.islice(group, fragment_turns))
            if not part:
                break
            yield number, part

    def runs(batches):
        """Fragments of sorted rows: ``(c, block, number, rows)``."""
        for (c, block), group in itertools.groupby(rows_of(batches, order), key=lambda r: r[:2]):
            for number, part in cut(group):
                yield c, block, number, part

    def reduce_fragments(batches):
        fields = pa.schema([("c", pa.int64()), ("block", pa.int64()), ("number", pa.int64()), ("turns", pa.int64()),
                            ("m", pa.list_(pa.int64()))])
        yield from record_batches(
            ((c, block, number, len(part), fragment_matrix([role_state(r[3]) for r in part]).ravel().tolist())
             for c, block, number, part in runs(batches)), fields)

    small = base.select(*order).repartition("c", "block").sortWithinPartitions(*order)
    fragments = cut_lineage(small.mapInArrow(reduce_fragments, "c long, block long, number long, turns long, m array<long>"))

    def scan_conversations(batches):
        fields = pa.schema([("c", pa.int64()), ("block", pa.int64()), ("number", pa.int64()), ("entry", pa.int32()),
                            ("leave", pa.int32()), ("before", pa.int64()), ("last", pa.bool_())])
        for rb in batches:
            rows = []
            for c, parts in zip(rb.column("c").to_pylist(), rb.column("parts").to_pylist()):
                states = scan([np.array(p["m"], np.int64).reshape(N, N) for p in parts])
                before = 0
                for k, (p, (entry, leave)) in enumerate(zip(parts, states)):
                    rows.append((c, p["block"], p["number"], entry, leave, before, k == len(parts) - 1))
                    before += p["turns"]
            cols = zip(*rows) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, fields)], schema=fields)

    # one small row per fragment of a conversation, that is per FRAGMENT_TURNS turns
    scanned = (fragments.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("block", "number", "turns", "m"))).alias("parts"))
               .mapInArrow(scan_conversations, "c long, block long, number long, entry int, leave int, before long, last boolean"))
    # The states of a block are sorted before its rows, and one exchange brings both to one task.  A join would
    # not: AQE may broadcast the states and leave the rows of a block in their input splits, or split a skewed block.
    state = ["number", "entry", "leave", "before", "last"]
    kinds = {**dict(base.dtypes), **dict(scanned.dtypes)}
    both = (base.select(*base.columns, F.lit(1).alias("is_row"), *[F.lit(None).cast(kinds[n]).alias(n) for n in state])
            .unionByName(scanned.select("c", "block", *[F.lit(None).cast(kinds[n]).alias(n) for n in ("turn", "role", "text")],
                                        F.lit(0).alias("is_row"), *state)))

    def placed(batches):
        """Fragments of sorted rows with their states: ``(c, state, rows)``."""
        states = []
        rows = rows_of(batches, ["c", "block", "is_row", "turn", "role", "text", *state])
        for (c, _, is_row), group in itertools.groupby(rows, key=lambda r: r[:3]):
            if not is_row:
                states = [dict(zip(state, r[6:])) for r in group]
                continue
            for number, part in cut(group):
                yield c, states[number], part

    def rendered(batches):
        for c, state, part in placed(batches):
            rows, opened = [], state["entry"] != START
            path = trace([role_state(r[4]) for r in part], state["entry"], state["leave"])
            conv = None if c == NO_ID else c

            def turn_text(role, text):
                nonlocal opened
                head = f"{CLOSE}\n" if opened else ""
                opened = True
                return f"{head}{OPEN}{STATES[role]}\n{text}"

            for k, (row, (role, action, inserted)) in enumerate(zip(part, path)):
                at = 8 * (state["before"] + k)
                for j, extra in enumerate(inserted):
                    rows.append((conv, at + j, None, None, STATES[extra], "insert", turn_text(extra, "")))
                text = clean(row[5])
                shown = "\n" + text if action.endswith("merge") else turn_text(role, text)
                rows.append((conv, at + 7, row[3], row[4], STATES[role], action, shown))
            if state["last"]:
                at = 8 * (state["before"] + len(part))
                for j, extra in enumerate(end_inserts(state["leave"])):
                    rows.append((conv, at + j, None, None, STATES[extra], "insert", turn_text(extra, "")))
                rows[-1] = (*rows[-1][:-1], rows[-1][-1] + CLOSE + "\n")
            yield from rows

    def render(batches):
        yield from record_batches(rendered(batches), pa.schema(
            [("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("source_role", pa.string()),
             ("role", pa.string()), ("action", pa.string()), ("rendered", pa.string())]))

    return (both.repartition("c", "block").sortWithinPartitions("c", "block", "is_row", "number", "turn", "role", "text")
            .mapInArrow(render, "conv_id long, position long, turn long, source_role string, role string, action string, "
                                "rendered string"))
