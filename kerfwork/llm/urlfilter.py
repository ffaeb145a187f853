"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

A rule is "host/path": it fits its host and all subdomains if the URL's path starts
with the rule's; the longest one that fits wins. URLs that a rule labels train the
trees (logistic loss, histogram splits), which judge the others from features of the
URL: lengths, depth, digit ratio, entropies, parameter counts, separators, and how often
labelled URLs with its host suffixes and its first path segment were blocked.

Those rates are counted over all labelled URLs, each once, by a map-side combined sum
over ``SLOTS`` hash slots and ``FOLDS`` folds of URLs, so what comes to the driver has a
fixed bound. In training, a URL's rates leave out its own fold. The trees are grown from
the ``TRAIN_URLS`` distinct labelled URLs with the lowest hashes, or fewer.

Edge cases: a null URL or one without "://" has empty host and path, fits no rule and
is judged by the trees from its text; with labels of one kind only, or none, the
verdict is that kind, or allow. Repeated rows get equal results; pages are kept whole.
Columns other than page_id and url are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfwork.llm.common import LOWER, UPPER, cut, lower_ascii, small_batches

#: The rules of the registered query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Bounds of the training sample and of the table of rates.
TRAIN_URLS, SLOTS, FOLDS = 20_000, 1 << 15, 5
TREES, DEPTH, BINS, RATE = 40, 4, 32, 0.2


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, url) of ``pages`` with host, path, rule and label (the rule's verdict
    or null)."""
    parts = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer rule overrides
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, label = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(label)
    return parts.withColumn("rule", rule).withColumn("label", label)


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


LOWER_ASCII = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}


def pieces(url: str) -> tuple[str, str, str]:
    """(host, path, query) of a URL's text."""
    _, _, rest = url.partition("://")
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    whole = tail.partition("#")[0]
    path, _, query = whole.partition("?")
    return host.translate(LOWER_ASCII), path, query


def keys(host: Column, path: Column) -> Column:
    """The keys of a URL's rates, as in ``Lexical.keys``."""
    first = F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit(""))
    return F.array(F.concat(F.lit("top:"), F.substring_index(host, ".", -1)), F.concat(F.lit("second:"), F.substring_index(host, ".", -2)), F.concat(F.lit("first:"), first))


def slot(key: str) -> int:
    return ((xxhash.xxh64_intdigest(key, 42) + (1 << 63)) % (1 << 64) - (1 << 63)) % SLOTS


def fold(url: str) -> int:
    return zlib.crc32(url.encode()) % FOLDS


@dataclass
class Lexical:
    """Turns URLs into feature rows; holds the rates of the labelled: of each slot and
    fold, URLs and how many of them were blocked."""

    counts: np.ndarray = field(default_factory=lambda: np.zeros((SLOTS, FOLDS, 2)))
    base: float = 0.5

    def __post_init__(self) -> None:
        self.total = self.counts.sum(1)

    @staticmethod
    def keys(url: str) -> list[str]:
        host, path, _ = pieces(url)
        labels = host.split(".")
        return ["top:" + labels[-1], "second:" + ".".join(labels[-2:]), "first:" + (path.split("/")[1] if "/" in path else "")]

    def rates(self, url: str, apart: int | None = None) -> list[float]:
        """How often labelled URLs with its keys were blocked, without a fold."""
        out = []
        for key in self.keys(url):
            at = slot(key)
            n, blocked = self.total[at] - (self.counts[at, apart] if apart is not None else 0)
            out.append(float((blocked + 5 * self.base) / (n + 5)))
        return out

    def row(self, url: str, apart: int | None = None) -> list[float]:
        host, path, query = pieces(url)
        n = max(len(url), 1)
        segments = [s for s in path.split("/") if s]
        return [
            len(url), len(host), len(path), len(query), host.count(".") + 1, len(segments),
            sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in path) / max(len(path), 1), sum(not c.isalnum() for c in url) / n,
            entropy(url), entropy(host), entropy(path), query.count("&") + bool(query), query.count("="),
            url.count("-"), url.count("_"), url.count("%"), path.endswith("/"), "." in (segments[-1] if segments else ""), "#" in url,
            url.startswith("https"), max(map(len, segments), default=0),
            *self.rates(url, apart),
        ]

    def matrix(self, urls: list[str], training: bool = False) -> np.ndarray:
        return np.array([self.row(u, fold(u) if training else None) for u in urls], np.float64).reshape(len(urls), -1)


@dataclass
class Trees:
    lexical: Lexical
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature (-1: leaf), threshold, value; children of i at 2i+1, 2i+2

    def scores(self, urls: list[str]) -> np.ndarray:
        x = self.lexical.matrix(urls)
        total = np.full(len(urls), self.start)
        row = np.arange(len(urls))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(urls), np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                right = x[row, np.maximum(feature[at], 0)] > threshold[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += value[at]
        return 1 / (1 + np.exp(-total))


def grow(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple[tuple, np.ndarray]:
    nodes = 2 ** (DEPTH + 1) - 1
    feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    at = np.zeros(len(gradient), np.int64)
    for node in range(nodes):
        mine = np.flatnonzero(at == node)
        if not len(mine):
            continue
        g, h = gradient[mine].sum(), hessian[mine].sum()
        value[node] = RATE * g / (h + 1.0)
        if node >= 2**DEPTH - 1 or len(mine) < 20:
            continue
        best = (1e-6, -1, 0)
        for f in range(binned.shape[1]):
            b = binned[mine, f]
            gl, hl = np.cumsum(np.bincount(b, gradient[mine], BINS))[:-1], np.cumsum(np.bincount(b, hessian[mine], BINS))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain = np.where((hl > 1e-3) & (h - hl > 1e-3), gain, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] >= 0 and best[2] < len(edges[best[1]]):
            feature[node], threshold[node] = best[1], edges[best[1]][best[2]]
            at[mine] = 2 * node + 1 + (binned[mine, best[1]] > best[2])
    return (feature, threshold, value), value[at]


def train(urls: list[str], blocked: list[int], lexical: Lexical) -> Trees:
    y = np.array(blocked, np.float64)
    if not len(y) or y.min() == y.max():
        return Trees(lexical, 20.0 if len(y) and y.max() else -20.0, [])
    x = lexical.matrix(urls, training=True)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    start = math.log(y.mean() / (1 - y.mean()))
    raw, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        tree, step = grow(binned, edges, y - p, p * (1 - p))
        trees.append(tree)
        raw += step
    return Trees(lexical, start, trees)


def fit(labelled: DataFrame, most: int = TRAIN_URLS) -> Trees:
    """Fit on labelled URLs (url, host, path, label)."""
    ready = labelled.where(F.col("label").isNotNull() & F.col("url").isNotNull()).select("url", "host", "path", "label").distinct()
    ready = cut(ready.withColumn("y", (F.col("label") == "block").cast("int")).withColumn("fold", F.crc32(F.col("url").cast("binary")) % FOLDS))
    each = ready.select("fold", "y", F.explode(keys(F.col("host"), F.col("path"))).alias("key"))
    summed = each.groupBy(F.pmod(F.xxhash64("key"), F.lit(SLOTS)).alias("slot"), "fold").agg(F.count("*").alias("n"), F.sum("y").alias("blocked")).collect()
    counts = np.zeros((SLOTS, FOLDS, 2))
    for r in summed:  # SLOTS * FOLDS rows at most
        counts[r["slot"], r["fold"]] = r["n"], r["blocked"]
    n, blocked = ready.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    unit = F.xxhash64("url") / F.lit(2.0**64) + 0.5
    rows = sorted(tuple(r) for r in ready.where(unit < most / max(n, 1)).select("url", "y").collect())
    return train([u for u, _ in rows], [y for _, y in rows], Lexical(counts, blocked / n if n else 0.5))


def judge(pages: DataFrame, model: Trees) -> DataFrame:
    """``pages`` (page_id, url, host, path, rule, label) with verdict and score."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = ["page_id", "host", "path", "rule"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            score = shared.value.scores([u or "" for u in columns["url"].to_pylist()])
            verdict = [label or ("block" if s > 0.5 else "allow") for label, s in zip(columns["label"].to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([*[columns[n] for n in names], pa.array(verdict, pa.string()), pa.array(score)], [*names, "verdict", "score"])

    return pages.select(*names, "url", "label").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, score double")


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_rule(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return judge(pages, fit(pages))
