"""Divergence of sources within a language (operator 12).

Terms are counted per (lang, source) in one pass; a language keeps the terms
that enough of its documents hold, numbers them without gaps in term order, and
every source becomes sorted arrays of (term id, count), cut into blocks of
consecutive ids so that no array grows with the vocabulary.

Every unordered pair of sources of a language is one merge: the two groups'
arrays of a block are co-grouped, the shorter one's ids are found in the longer
one by galloping, and the pair is priced in both directions at once: terms that
both have, terms that one has, and terms that neither has (which all cost the
same).  Sources travel in tiles of ``TILE``, so that an array is copied once
per tile of partners and not once per partner.

Smoothed probabilities are integers, p = 1 + floor(SCALE * (n + 1) / (N + V)),
and a term's price is floor((p - q)^2 / q); no step rounds.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from ..operators.ranges import with_position
from .common import cut_lineage

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
BLOCK = 16_384              # consecutive term ids in one array
TILE = 8                    # sources that travel together
TALLY_ENTRIES = 400_000     # terms a task counts before it hands them on
TEXT_BYTES = 1 << 20        # bytes of a text that are split at a time
SMALL_ROWS = 100_000        # tables of languages and sources up to this many rows are broadcast

#: Letters A-Z become a-z, every other ASCII character but a-z a blank; bytes
#: from 0x80 on (parts of other characters) belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _term_lists(raw: bytes):
    """The terms of a text, some at a time."""
    folded, at = raw.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + TEXT_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()),
                     ("docs", pa.int64())])


def _count_terms(batches):
    """Arrow batches of (text, lang, source) to partial counts; a row with a
    null term tells that the group exists."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    held = 0

    def given():
        for (lang, source), terms in counts.items():
            df = docs[lang, source]
            names = [None, *terms]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()),
                pa.array(names, pa.binary()).cast(pa.string()),
                pa.array([0, *terms.values()], pa.int64()), pa.array([0, *(df[t] for t in terms)], pa.int64()),
            ], schema=_COUNTS)

    for rb in batches:
        for raw, lang, source in zip(*(c.to_pylist() for c in rb.columns)):
            key = lang, source
            n, df, seen = counts[key], docs[key], set()
            before = len(n)
            for terms in _term_lists(raw):
                n.update(terms)
                seen.update(terms)
            df.update(seen)
            held += len(n) - before
            if held >= TALLY_ENTRIES:
                yield from given()
                counts.clear()
                docs.clear()
                held = 0
    yield from given()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of a term in the group and
    the group's documents that hold it; a row with a null term for each group.
    Nulls count as ''.  Groups meet by (lang, term), which no source is hot in."""
    col = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))                      # noqa: E731
    rows = docs.select(col(text).cast("binary").alias("text"), col(lang).alias("lang"), col(source).alias("source"))
    found = rows.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return found.repartition("lang", "term").groupBy("lang", "source", "term") \
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, total``: terms that ``min_docs`` documents of
    the language hold, with the language's occurrences as ``total``."""
    of_term = Window.partitionBy("lang", "term")
    return counts.filter("term IS NOT NULL") \
        .withColumns({"total": F.sum("n").over(of_term), "_df": F.sum("docs").over(of_term)}) \
        .filter(F.col("_df") >= min_docs).drop("_df", "docs")


def probability(n: str, size: str, terms: str):
    """1 + floor(SCALE * (n + 1) / (size + terms)), exactly."""
    wide = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0))"
    return F.expr(f"1 + ({wide} div CAST({size} + {terms} AS DECIMAL(20,0)))")


class Audit:
    """What :func:`audit_sources` returns: ``pairs`` (``lang, source, item,
    value, rank``: other sources, all ranks) and ``terms`` (``lang, source, item,
    value, rank``: terms the source overuses, the first ``top_terms``)."""

    def __init__(self, pairs: DataFrame, terms: DataFrame):
        self.pairs, self.terms = pairs, terms


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> Audit:
    """Divergence of every source of a language from each other source and,
    term by term, from the language.

    Null text, lang and source count as ''; empty texts and sources without
    terms take part as groups without counts (divergence 0 where the language
    keeps no term); repeated rows are documents of their own; ties go to the
    smaller item in UTF-8; an empty table gives no rows; other columns are
    ignored.
    """
    counts = cut_lineage(term_counts(docs))
    kept = cut_lineage(kept_terms(counts, min_docs))
    terms = kept.groupBy("lang", "term").agg(F.first("total").alias("total"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.filter("term IS NULL").select("lang", "source")
    numbered = with_position(groups, ["source"], ["lang"]) \
        .withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    groups = cut_lineage(numbered.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", (F.col("pos") - 1).alias("no"), "sources",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("size", "v", "lang_n")]))
    return Audit(ranked(_pair_prices(kept, terms, groups)), _term_prices(kept, groups, top_terms))


def ranked(prices: DataFrame, top: int | None = None) -> DataFrame:
    """``prices`` with ``rank`` by value descending, then item, per source."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = prices.withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= top) if top else out


def _term_prices(kept, groups, top_terms):
    of_group = broadcast_if_small(groups.select("lang", "source", "size", "v", "lang_n"), SMALL_ROWS)
    p = kept.join(of_group, ["lang", "source"]).withColumns(
        {"p": probability("n", "size", "v"), "q": probability("total", "lang_n", "v")}).filter("p > q")
    return ranked(p.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value")),
                  top_terms)


def _pair_prices(kept, terms, groups):
    """``lang, source, item, value`` of every ordered pair of sources."""
    ids = with_position(terms.select("lang", "term"), ["term"], ["lang"]).withColumn("id", F.col("pos") - 1)
    arrays = kept.join(ids, ["lang", "term"]) \
        .groupBy("lang", "source", F.floor(F.col("id") / BLOCK).alias("block")) \
        .agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("x")) \
        .select("lang", "source", "block", F.col("x.id").alias("ids"), F.col("x.n").alias("counts"))
    # a source without counts in a block is there with empty arrays
    last = F.greatest(F.ceil(F.col("v") / BLOCK) - 1, F.lit(0))
    every = groups.filter("sources > 1").select(
        "lang", "source", "size", "v", F.floor(F.col("no") / TILE).alias("tile"),
        F.floor((F.col("sources") - 1) / TILE).alias("last_tile"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    sides = cut_lineage(every.join(arrays, ["lang", "source", "block"], "left")
                        .withColumn("wide", F.least(F.col("v") - F.col("block") * BLOCK, F.lit(BLOCK))))
    row = ["lang", "source", "block", "size", "v", "wide", "ids", "counts"]
    left = sides.select(*row, F.col("tile").alias("t"), F.explode(F.expr("sequence(tile, last_tile)")).alias("u"))
    right = sides.select(*row, F.explode(F.expr("sequence(0L, tile)")).alias("t"), F.col("tile").alias("u"))
    meet = ["lang", "block", "t", "u"]
    parts = left.groupBy(*meet).cogroup(right.groupBy(*meet)) \
        .applyInArrow(_price_tiles, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


# -- inside a task: numpy over sorted arrays of one block ----------------------

def smoothed(counts: np.ndarray, size: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / (size + terms)) as int64, by long
    division in three steps of 1000, which can't overflow."""
    left, over = np.asarray(counts, np.int64) + 1, size + terms
    out = np.zeros(len(left), np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // over
        left = left % over
    return out + 1


def prices(p, q):
    """floor((p - q)^2 / q)."""
    d = p - q
    return d * d // q


def gallop(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """For each of the sorted ``needles`` the first position of ``hay`` that is
    not below it: from a guess in proportion, the step doubles until the needle
    is enclosed, then the enclosure is halved."""
    n = len(hay)
    low = np.arange(len(needles), dtype=np.int64) * n // max(len(needles), 1)
    high = low.copy()
    for bound, sign in ((low, -1), (high, 1)):
        step = 1
        while True:
            inside = (bound > 0) if sign < 0 else (bound < n)
            at = np.flatnonzero(inside)
            probe = hay[bound[at] - 1] >= needles[at] if sign < 0 else hay[bound[at]] < needles[at]
            at = at[probe]
            if not len(at):
                break
            bound[at] = np.clip(bound[at] + sign * step, 0, n)
            step *= 2
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        below = hay[mid] < needles[open_]
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]


class _Side:
    """A source's arrays of one block, with their probabilities."""

    def __init__(self, source, size, v, wide, ids, counts):
        self.source, self.wide = source, wide
        self.ids = np.asarray(ids if ids is not None else [], np.int64)
        self.p = smoothed(counts if counts is not None else [], size, v) if v else np.zeros(0, np.int64)
        self.none = smoothed(np.zeros(1, np.int64), size, v)[0] if v else np.int64(1)


def price_pair(a: _Side, b: _Side) -> tuple[int, int]:
    """The block's price of a against b, and of b against a."""
    if len(a.ids) > len(b.ids):
        return price_pair(b, a)[::-1]
    at = gallop(a.ids, b.ids)
    both = np.zeros(len(a.ids), bool)
    inside = at < len(b.ids)
    both[inside] = b.ids[at[inside]] == a.ids[inside]
    alone_b = np.ones(len(b.ids), bool)
    alone_b[at[both]] = False
    pa_, pb, only_a, only_b = a.p[both], b.p[at[both]], a.p[~both], b.p[alone_b]
    absent = a.wide - len(a.ids) - len(b.ids) + int(both.sum())
    there = prices(pa_, pb).sum() + prices(only_a, b.none).sum() + prices(a.none, only_b).sum()
    back = prices(pb, pa_).sum() + prices(b.none, only_a).sum() + prices(only_b, a.none).sum()
    return (int(there) + absent * int(prices(a.none, b.none)), int(back) + absent * int(prices(b.none, a.none)))


_PRICES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _price_tiles(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """All pairs of a tile with another one, or with itself."""
    lang, _, t, u = (k.as_py() for k in key)

    def sides(table):
        return [_Side(*x) for x in zip(*(table[c].to_pylist() for c in ("source", "size", "v", "wide", "ids", "counts")))]

    out = []
    others = sides(right)
    for a in sides(left):
        for b in others:
            if t < u or a.source < b.source:
                there, back = price_pair(a, b)
                out += [(lang, a.source, b.source, there), (lang, b.source, a.source, back)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PRICES)] if out else
                                [pa.array([], f.type) for f in _PRICES], schema=_PRICES)
