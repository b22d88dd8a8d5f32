"""SimHash near-dedup (operator 3).

Fingerprints of 64 bits from word shingles; two link at few differing bits.
With at most 2 differing bits a pair agrees in at least 6 of its 8 positional
bytes.  The inverted index lists fingerprints by the bytes they hold at given
positions.  As a list of one byte would hold 1/256 of everything, a list is
keyed by four positions (two of the four byte pairs): whatever 2 bytes differ,
one such choice is unharmed, so a linked pair meets in a list.  Of every pair
in a list the shared positional bytes are tallied, pairs with fewer than the
guaranteed number are dropped, and the rest verified by their differing bits.

Lists of over LIST_CAP fingerprints are not paired off: each member goes to
the 33 points within one bit of it (in the bytes the list leaves free), and
two members within 2 bits meet at such a point, which holds 33 members at
most.  So work grows with the fingerprints, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, cut_lineage, doc_columns, text_bytes
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
LIST_CAP = 64
BYTES = 8
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the shingles' hashes, as a signed 64-bit."""
    w = text_bytes(text).lower().split()                 # ASCII lower case and white space
    if not w:
        return 0
    if len(w) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    else:
        h = xxhash.xxh64_intdigest
        hashes = [h(s, SEED) for s in map(b" ".join, zip(*(w[k:] for k in range(words))))]
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[a:a + (1 << 16)], np.uint64).astype(">u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, *beside) -> DataFrame:
    """``doc_id, fp long`` of every row (a null text has no words: 0), and
    string columns ``beside``, made of ``doc_id`` and ``text``."""
    rows = doc_columns(docs).select("doc_id", "text", *beside)
    more = rows.columns[2:]
    fields = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), *[(n, pa.string()) for n in more]])

    def run(batches):
        for ids, texts, *others in columns_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()),
                                              pa.array([fingerprint(t, words) for t in texts], pa.int64()),
                                              *[pa.array(x, pa.string()) for x in others]], schema=fields)

    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *[f"{n} string" for n in more]]))


def shared_bytes(x):
    """Positional bytes in which two fingerprints of this XOR agree."""
    return sum((F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)) == 0).cast("int") for k in range(BYTES))


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``a, b`` that connect exactly what pairs of at most ``max_bits``
    differing bits connect.  ``nodes``: distinct ``fp``."""
    if max_bits > 2:
        raise ValueError("the lists guarantee a meeting for at most 2 differing bits")
    pairs_of_bytes = [0xFFFF << (16 * k) for k in range(4)]
    masks = [x | y for x, y in combinations(pairs_of_bytes, 2)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("held"))
                                 for i, m in enumerate(masks)]))
    lists = nodes.select("fp", choice.alias("c")).select("fp", "c.choice", "c.held")
    sizes = cut_lineage(lists.groupBy("choice", "held").count().filter("count > 1"))
    listed = lists.join(sizes, ["choice", "held"])

    # short lists: pairs, tallied and verified
    short = (listed.filter(F.col("count") <= LIST_CAP).groupBy("choice", "held")
             .agg(F.collect_list("fp").alias("fps")))
    x = F.col("a").bitwiseXOR(F.col("b"))
    paired = (short.select("fps", F.explode("fps").alias("a"))
              .select("a", F.explode(F.filter("fps", lambda b: b > F.col("a"))).alias("b"))
              .filter(shared_bytes(x) >= BYTES - max_bits)
              .filter(F.bit_count(x) <= max_bits))

    # long lists: points within one bit, in the bytes that the list leaves free
    flips = F.create_map(*[v for i, m in enumerate(masks) for v in (
        F.lit(i), F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << k)).cast("long") for k in range(64) if not m >> k & 1]))])
    met = (listed.filter(F.col("count") > LIST_CAP)
           .select("choice", "fp", F.explode(flips[F.col("choice")]).alias("flip"))
           .groupBy("choice", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
           .agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1))
    y = F.col("a").bitwiseXOR(F.col("b"))
    starred = (met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a != b")
               .filter(F.bit_count(y) <= max_bits))
    if max_bits < 2:                                     # a point's members may be 2 bits apart
        starred = (met.select("fps", F.explode("fps").alias("a"))
                   .select("a", F.explode(F.filter("fps", lambda b: b > F.col("a"))).alias("b"))
                   .filter(F.bit_count(y) <= max_bits))
    return paired.unionByName(starred)


def component_roots(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, least, root`` of every fingerprint: its least doc_id and the
    fingerprint that its component is known by."""
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(links(nodes.select("fp"), max_bits))
    return cut_lineage(nodes.join(parts, nodes["fp"] == parts["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")))


def simhash_groups(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits)
    and ``component_id``, the smallest doc_id reachable over links.

    A null or empty text has fingerprint zero and is linked like any other.
    Null doc_ids take part but never name a component (it is null where a
    component has no other); repeated rows give repeated rows; an empty table
    gives none; other columns are ignored.
    """
    fps = cut_lineage(fingerprints(docs, words))
    rooted = component_roots(fps, max_bits)
    roots = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut_lineage(rooted.join(roots, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with all columns of ``docs``: that of the
    least doc_id (a null one only where there is no other), and of several
    texts under it the one with the least SHA-256.  Of rows alike in both, one
    stays.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    fps = cut_lineage(fingerprints(docs, words, sha.alias("sha")))
    named = fps.join(component_roots(fps, max_bits).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha")).alias("first")
    keys = named.groupBy("root").agg(first).select(
        F.coalesce("first.doc_id", F.lit(NO_ID)).alias("__k"), F.col("first.sha").alias("__s"))
    marked = docs.withColumns({"__k": key, "__s": sha})
    return marked.join(keys, ["__k", "__s"], "left_semi").dropDuplicates(["__k", "__s"]).select(*docs.columns)
