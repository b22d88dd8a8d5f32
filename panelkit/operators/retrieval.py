"""Text chunks, vector normalisation, exact cosine top-k, snippets.

Whole texts are processed: a document becomes an array of window start
offsets, every window is cut with ``substring`` inside the JVM.  The search
itself is in :mod:`.search`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col_
from .search import search

CHUNK_SIZE = 1100     # fixed values of the reference
CHUNK_OVERLAP = 150
SNIPPET_CHARS = 420
TOP_K = 4
TOP_K_MAX = 8         # the question tool's limit, see tool_k

# Python str.isspace() characters, as a Java regex class.
WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


# The same characters as a plain set (fixed values: Python's str.isspace()).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """Python ``str.strip()``: trim a character set from both ends (no regex,
    linear in the trimmed length)."""
    return F.trim(col_(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """Python ``" ".join(s.split())``."""
    return F.regexp_replace(py_strip(c), f"{WS}+", " ")


def check_chunking(size: int, overlap: int) -> int:
    if size <= 0:
        raise ValueError("chunk_size must be positive")
    if overlap < 0:
        raise ValueError("chunk_overlap must not be negative")
    step = size - overlap
    if step <= 0:
        raise ValueError("chunk_size must be larger than chunk_overlap")
    return step


def chunk_corpus(docs: DataFrame, text: str = "text", ids=("doc_id", "source"),
                 size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; each
    window is stripped, empty ones dropped, numbering after the drop; the
    last window is the first that reaches the end.  Empty documents vanish."""
    step = check_chunking(size, overlap)
    s = docs.select(*ids, py_strip(text).alias("_t"))
    s = s.withColumn("_L", F.length("_t")).filter(F.col("_L") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.col("_L") - size) / step)).cast("int")
    wins = F.transform(F.sequence(F.lit(0), last), lambda k: py_strip(F.substring("_t", k * step + 1, size)))
    kept = F.filter(wins, lambda c: F.length(c) > 0)
    # posexplode_outer: the inner form makes Catalyst infer a size filter
    # that would cut every document twice; rows without chunks drop below.
    return s.select(*ids, F.posexplode_outer(kept).alias("chunk_id", "text")).filter(F.col("text").isNotNull())


def l2_normalise(vec) -> Column:
    """V / |v| (a zero vector stays zero)."""
    v = F.transform(col_(vec), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def tool_k(k: int) -> int:
    """The question tool's clamp of k to 1..8; the search has no upper limit."""
    return max(1, min(int(k), TOP_K_MAX))


def cosine_topk(corpus: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
                k: int = TOP_K) -> DataFrame:
    """Exact cosine top-k of every query against the corpus, as ``query,
    rank, id, score``; see :mod:`.search`."""
    return search(corpus, queries, id_col, vec, k).hits


def snippet(text) -> Column:
    """Collapsed white space, at most 420 characters, then '...'."""
    s = collapse_ws(text)
    return F.when(F.length(s) > SNIPPET_CHARS,
                  F.concat(F.regexp_replace(F.substring(s, 1, SNIPPET_CHARS), f"{WS}+$", ""), F.lit("...")))\
        .otherwise(s)
