"""URL filter by gradient-boosted trees on lexical features (operator 8).

Rules of host and path label the URLs they fit; boosted regression trees learn
from a bounded sample of those labels what blocked URLs look like (length,
depth, digit ratio, entropy, parameter counts, and how often URLs of the same
host suffix were blocked, counted over all labelled rows) and judge the URLs
that no rule fits.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, hash_sample

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
SAMPLE_ROWS = 20_000        # bound of the training sample
SUFFIXES = 5_000            # suffixes with statistics, the most frequent ones
LABEL_CHARS = 63            # fixed value: the longest label of a host name
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
MIN_LEAF = 5
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "host_entropy",
            "parameters", "dashes", "longest_run", "suffix_blocked", "suffix_rows")


def split_url(url):
    """Host and path columns of a URL column; both empty where there is no
    ``://`` or the URL is null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host, path, rules=RULES):
    """The longest fitting rule and its verdict (both null without one)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):       # longer ones last, so they win
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _suffix(host: str):
    """What follows the last dot; '' where it is too long for a label, so that
    a table of suffixes is bounded in bytes too."""
    last = F.substring_index(host, ".", -1)
    return F.when(F.length(last) <= LABEL_CHARS, last).otherwise("")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def features(urls, hosts, paths, blocked, seen) -> np.ndarray:
    """Feature matrix in the order of FEATURES."""
    out = np.zeros((len(urls), len(FEATURES)))
    for i, (u, h, p) in enumerate(zip(urls, hosts, paths)):
        u = u or ""
        query = u.partition("?")[2].partition("#")[0]
        run = longest = 0
        for c in h + p:
            run = run + 1 if c.isalnum() else 0
            longest = max(longest, run)
        out[i, :11] = (len(u), len(h), len(p), sum(1 for x in p.split("/") if x), h.count(".") + bool(h),
                       sum(c.isdigit() for c in u) / max(1, len(u)), entropy(u), entropy(h),
                       sum(1 for x in query.split("&") if x), u.count("-") + u.count("_"), longest)
    out[:, 11] = blocked
    out[:, 12] = np.log1p(seen)
    return out


def stats_of(suffixes, table, prior):
    """Share of blocked URLs and number of rows of each suffix."""
    return zip(*(table.get(s, (prior, 0)) for s in suffixes)) if suffixes else ((), ())


class BoostedTrees:
    """Logistic boosting of depth-limited trees over binned features."""

    def __init__(self):
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> "BoostedTrees":
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = math.log(share / (1 - share))
        if len(np.unique(y)) < 2:
            return self
        edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
        bins = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)], 1)
        f = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(bins, edges, y - p, p * (1 - p), np.arange(len(y)), depth)
            self.trees.append(tree)
            f += self._apply(tree, x)
        return self

    def _grow(self, bins, edges, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = RATE * g / (h + 1)
        if not depth or len(rows) < 2 * MIN_LEAF:
            return leaf
        best = (1e-6, None, None)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b = bins[rows, j]
            n = len(e) + 1
            gl = np.cumsum(np.bincount(b, grad[rows], n))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], n))[:-1]
            cl = np.cumsum(np.bincount(b, minlength=n))[:-1]
            gain = gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1)
            gain[(cl < MIN_LEAF) | (len(rows) - cl < MIN_LEAF)] = 0
            s = int(gain.argmax())
            if gain[s] > best[0]:
                best = (gain[s], j, s)
        if best[1] is None:
            return leaf
        _, j, s = best
        left = bins[rows, j] <= s
        return (j, edges[j][s], self._grow(bins, edges, grad, hess, rows[left], depth - 1),
                self._grow(bins, edges, grad, hess, rows[~left], depth - 1))

    def _apply(self, tree, x):
        out = np.empty(len(x))
        work = [(tree, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if not isinstance(node, tuple):
                out[rows] = node
                continue
            j, cut, low, high = node
            left = x[rows, j] <= cut
            work += [(low, rows[left]), (high, rows[~left])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for tree in self.trees:
            f += self._apply(tree, x)
        return 1 / (1 + np.exp(-f))


def judge(pages: DataFrame, rules=RULES, url_col: str = "url", id_col: str = "page_id",
          sample_rows: int = SAMPLE_ROWS, suffixes: int = SUFFIXES) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_probability`` per page.

    The verdict is the rule's, else ``block`` where the trees give 0.5 or more.
    A null URL or one without ``://`` has empty host and path and is judged by
    the trees; with no labelled URL, or one label only, the trees are constant
    (no label: allow).  Repeated rows and null ids are judged like others;
    other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    host, path = split_url(url)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said"), _suffix("host").alias("suffix"))

    labelled = rows.filter("said is not null").withColumn("y", (F.col("said") == "block").cast("int"))
    counts = labelled.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("y").alias("bad"))
    # statistics of the most frequent suffixes: a bounded table
    top = counts.orderBy(F.desc("n"), "suffix").limit(suffixes).collect()
    n, bad = sum(r["n"] for r in top), sum(r["bad"] for r in top)
    prior = bad / n if n else 0.0
    table = {r["suffix"]: ((r["bad"] + 5 * prior) / (r["n"] + 5), r["n"]) for r in top}
    known = rows.sparkSession.sparkContext.broadcast((table, prior))

    def sampled(batches):
        """Features of the sample, made where its URLs are: what reaches the
        driver is bounded in bytes, however long they are."""
        table, prior = known.value
        for urls, hosts, paths, suffix, y in columns_of(batches):
            x = features(urls, hosts, paths, *stats_of(suffix, table, prior))
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(y, pa.int32())], names=["x", "y"])

    sample = hash_sample(labelled.select("page_id", "url", "host", "path", "suffix", "y"), ["page_id", "url"], sample_rows) \
        .select("url", "host", "path", "suffix", "y").mapInArrow(sampled, "x array<double>, y int").orderBy("x", "y").collect()
    model = BoostedTrees()
    if sample:
        model.fit(np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample], float))
    else:
        model.base = -math.inf
    sent = rows.sparkSession.sparkContext.broadcast((model.base, model.trees))
    fields = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()),
                        ("said", pa.string()), ("block_probability", pa.float64())])

    def run(batches):
        net = BoostedTrees()
        net.base, net.trees = sent.value
        table, prior = known.value
        for ids, urls, hosts, paths, ruled, said, suffix in columns_of(batches):
            p = net.probability(features(urls, hosts, paths, *stats_of(suffix, table, prior)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in
                                              zip((ids, hosts, paths, ruled, said, p), fields)], schema=fields)

    rows = rows.withColumn("page_id", F.col("page_id").cast("long"))
    scored = rows.mapInArrow(run, "page_id long, host string, path string, rule string, said string, block_probability double")
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("said", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")).alias("verdict"),
                         "block_probability")
