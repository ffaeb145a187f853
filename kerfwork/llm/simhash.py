"""SimHash near-dedup with bit-sliced comparison.

A fingerprint bit is 1 if it is set in over half of the XXH64 (seed 42) hashes of a
text's word shingles, repeats included. Two fingerprints link at ``RADIUS`` or fewer
differing bits; components of linked fingerprints are the near-duplicate groups.

Only distinct fingerprints are compared. They are cut into radius + 2 blocks of bits:
two that link agree on two of the blocks at least, so candidates are those equal in
some pair of blocks (equi-partitioned by it, every pair of blocks). Inside such a
bucket, fingerprints are stored vertically: 64 of them fill one word of each of the
64 bit planes. A query is compared with all lanes of many words at once: planes are
XORed with its bit and added by carry-save full adders to bitwise counters; a word is
abandoned once all its lanes exceed the radius. A bucket gives one edge from each of
its fingerprints to the least of its component there, so no group is written as pairs.
A bucket above ``LARGE`` is first split by the same pigeonhole over its other bits,
which loses no link; a hot bucket (see ``common.hot_limit``) already before it is dealt
to a task.

Components come from alternating hooks to the least neighbour and pointer jumps over
edges, which are cut by a checkpoint each round. Hubs of components are hot keys of
those joins: their rows meet a broadcast of the few hot labels.

Edge cases: null text counts as empty; no words give fingerprint zero, linked like
any other; fewer words than a shingle make one shingle of them all. Repeated rows have
the same component. A null id takes part as a document but never names a component
unless all of its ids are null (then it is null).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfwork.llm.common import cut, hot_limit, join_hot, map_texts, nothing_live, numbered, row_order, small_batches

BITS, RADIUS, SHINGLE = 64, 2, 3
LARGE = 4096
#: Shingle hashes counted at once.
STEP = 1 << 16


def shingles(text: str, size: int) -> np.ndarray:
    """XXH64 hashes of a text's word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    flat = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length) - 1
    begin = end - length + 1
    n = max(1, len(words) - size + 1)
    last = end[min(size, len(words)) - 1 :][:n]
    h = xxhash.xxh64_intdigest
    return np.array([h(flat[a:b], 42) for a, b in zip(begin[:n].tolist(), last.tolist(), strict=True)], "<u8")


def fingerprint(text: str, size: int = SHINGLE) -> int:
    hashes = shingles(text, size)
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, STEP):
        part = hashes[at : at + STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def blocks(parts: int) -> list[tuple[int, int]]:
    """(shift, width) of ``parts`` blocks that cover the bits."""
    edges = [BITS * i // parts for i in range(parts + 1)]
    return list(zip(edges[:-1], np.diff(edges).tolist(), strict=True))


def planes(values: np.ndarray) -> np.ndarray:
    """(BITS, words): bit b of 64 values is one word of plane b."""
    words = -(-len(values) // 64)
    full = np.zeros(words * 64, np.uint64)
    full[: len(values)] = values
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # (values, BITS)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(query: int, sliced: np.ndarray, radius: int) -> np.ndarray:
    """Words of lanes at ``radius`` or fewer bits from the query."""
    if radius > 3:
        raise ValueError("counters of two bits count to a radius of 3")
    above = (lambda low, high: low | high, lambda low, high: high, lambda low, high: high & low, lambda low, high: np.uint64(0))[radius]
    words = sliced.shape[1]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    over = np.zeros(words, np.uint64)
    low, high = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
    live = np.arange(words)
    part = sliced
    for b in range(0, BITS, 2):
        x = part[b] ^ full if query >> b & 1 else part[b]
        y = part[b + 1] ^ full if query >> (b + 1) & 1 else part[b + 1]
        # Full adder: low + x + y; its carry goes to high, whose carry is over 3.
        half = low ^ x
        carry = (low & x) | (half & y)
        low = half ^ y
        over |= high & carry
        high = high ^ carry
        if b % 16 == 14:
            over |= above(low, high)
            if (over == full).any():
                left = over != full
                live, over, low, high = live[left], over[left], low[left], high[left]
                part = part[:, left]
                if not len(live):
                    break
    out = np.zeros(words, np.uint64)
    out[live] = ~(over | above(low, high))
    return out


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def links(values: np.ndarray, radius: int = RADIUS, free: tuple[tuple[int, int], ...] = (), large: int = LARGE) -> np.ndarray:
    """For each of the distinct ``values``, the place of the least value of its
    component. ``free``: blocks (shift, width) in which they may differ."""
    parent = np.arange(len(values))

    def join(i: int, j: int) -> None:
        a, b = _find(parent, i), _find(parent, j)
        if a != b:
            parent[max(a, b)] = min(a, b)

    def compare(place: np.ndarray) -> None:
        sliced = planes(values[place])
        for i in range(len(place)):
            word = i // 64
            hits = near(int(values[place[i]]), sliced[:, word:], radius)
            for w in np.flatnonzero(hits):
                bits = int(hits[w])
                while bits:
                    j = (word + int(w)) * 64 + (bits & -bits).bit_length() - 1
                    if i < j < len(place):
                        join(int(place[i]), int(place[j]))
                    bits &= bits - 1

    def split(place: np.ndarray, free: tuple[tuple[int, int], ...]) -> None:
        width = sum(w for _, w in free)
        if len(place) <= large or width < 2 * (radius + 1):
            compare(place)
            return
        bits = [s + i for s, w in free for i in range(w)]
        for part in np.array_split(bits, radius + 1):
            mask = np.uint64(sum(1 << int(b) for b in part))
            rest = tuple((b, 1) for b in bits if b not in set(part.tolist()))
            key = values[place] & mask
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.diff(key[order])) + 1
            for group in np.split(place[order], edges):
                if len(group) > 1:
                    split(np.sort(group), rest)

    split(np.arange(len(values)), free or ((0, BITS),))
    return np.array([_find(parent, i) for i in range(len(values))], np.int64)


def fingerprints(docs: DataFrame, size: int = SHINGLE, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and fp, the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda texts: [np.array([fingerprint(t or "", size) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, list(keep), {"fp": "long"}, make)


def edges(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): for fingerprints that link inside some bucket, the least of their
    component there (a, unsigned order) and themselves (b)."""
    spark = distinct.sparkSession
    small_batches(spark)
    parts = blocks(radius + 2)
    pairs = list(combinations(range(len(parts)), 2))
    masks = [sum(((1 << w) - 1) << s for s, w in (parts[i], parts[j])) for i, j in pairs]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    signed_of = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    keyed = distinct.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"), "fp", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub"))
    # A hot bucket is dealt by radius + 1 parts of its other bits: two that link are
    # equal in one of them.
    rows = distinct.count() * len(pairs)
    hot = cut(keyed.groupBy("t", "key").count().where(F.col("count") > max(hot_limit(rows), LARGE // 8)).select("t", "key", F.lit(True).alias("hot")))
    if hot.count():
        marked = keyed.join(F.broadcast(hot), ["t", "key"], "left")  # HOT_PART rows at most
        other = [[b for k, (s, w) in enumerate(parts) if k not in pair for b in range(s, s + w)] for pair in pairs]
        splits = [[signed_of(sum(1 << int(b) for b in some)) for some in np.array_split(bits, radius + 1)] for bits in other]
        choice = F.array(*[F.array(*some) for some in splits])
        again = marked.where("hot").select("t", "key", "fp", F.posexplode(F.get(choice, F.col("t"))).alias("part", "mask"))
        keyed = marked.where("hot IS NULL").select("t", "key", "fp", "part", "sub").unionByName(again.select("t", "key", "fp", "part", F.col("fp").bitwiseAND(F.col("mask")).alias("sub")))
    dealt = keyed.select("t", "key", "part", "sub", "fp").repartition("t", "key", "part", "sub").sortWithinPartitions("t", "key", "part", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: int, values: np.ndarray) -> pa.RecordBatch:
            order = np.sort(values.view(np.uint64))
            free = tuple(p for k, p in enumerate(parts) if k not in pairs[t])
            least = links(order, radius, free)
            moved = least != np.arange(len(order))
            return pa.RecordBatch.from_pydict({"a": order[least[moved]].view(np.int64), "b": order[moved].view(np.int64)})

        nothing_live()
        held_t, held_key, held = None, None, []
        for batch in batches:
            t, key, split, sub, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(t):
                continue
            edge = np.flatnonzero(sum(np.diff(x) != 0 for x in (t, key, split, sub))) + 1
            bounds = [0, *edge.tolist(), len(t)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                here = (int(t[a]), int(key[a]), int(split[a]), int(sub[a]))
                if here != held_key:
                    if sum(map(len, held)) > 1:
                        yield found(held_t, np.concatenate(held))
                    held_t, held_key, held = here[0], here, []
                held.append(fp[a:b])
        if sum(map(len, held)) > 1:
            yield found(held_t, np.concatenate(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(links_: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): the least node reachable. Each
    round, edges (node, parent) hook every parent to the least parent of its
    children and jump one step up; degree does not matter, as only minima travel."""
    both = links_.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links_.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = cut(both)
    n_edges = both.count()
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    n_nodes = labels.count()
    while True:
        heard = join_hot(both, labels.select(F.col("node").alias("w"), F.col("root").alias("r")), "v", "w", n_edges)
        told = heard.groupBy("u").agg(F.min("r").alias("r"))
        hooked = labels.join(told, labels["node"] == told["u"]).select("node", "root", F.least("root", "r").alias("new"))
        # The old root learns the least label of its members, too.
        roots = hooked.groupBy("root").agg(F.min("new").alias("up")).select(F.col("root").alias("head"), "up")
        raised = cut(hooked.join(roots, hooked["node"] == roots["head"], "left").select("node", "root", F.least("new", F.coalesce("up", "new")).alias("new")))
        top = raised.select(F.col("node").alias("head"), F.col("new").alias("up"))
        jumped = cut(join_hot(raised, top, "new", "head", n_nodes, "left").select("node", "root", F.least("new", F.coalesce("up", "new")).alias("new")))
        changed = jumped.where(F.col("root") != F.col("new")).limit(1).count()
        labels = jumped.select("node", F.col("new").alias("root"))
        if not changed:
            return labels


def fingerprint_groups(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(__fp, root, component_id) for the fingerprints of ``marked`` (doc_id, fp)."""
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(edges(distinct.select("fp"), radius))
    named = cut(found.join(distinct, found["node"] == distinct["fp"]).select("fp", "root", "first"))
    least = named.groupBy("root").agg(F.min("first").alias("linked")).withColumnRenamed("root", "head")
    linked = cut(join_hot(named, least, "root", "head", named.count()).select(F.col("fp").alias("__fp"), "root", "linked"))
    groups = distinct.join(linked, distinct["fp"] == linked["__fp"], "left").select(F.col("fp").alias("__fp"), F.coalesce("root", "fp").alias("root"), F.coalesce("linked", "first").alias("component_id"))
    # Written, so that the last join stands alone and a fingerprint of very many exact
    # copies can be split over tasks.
    return cut(groups)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    marked = cut(fingerprints(docs, size))
    groups = fingerprint_groups(marked, radius)
    return marked.join(groups, marked["fp"] == groups["__fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows that aren't the first of their group: the one of the
    lowest id (by hash of the text among equal ids), null ids last."""
    rows = numbered(docs)
    marked = cut(fingerprints(rows.select("doc_id", "text", row_order().alias("order")), size, ["doc_id", "order"]))
    groups = fingerprint_groups(marked, radius)
    best = marked.groupBy("fp").agg(F.min("order").alias("first"))
    kept = best.join(groups, best["fp"] == groups["__fp"]).groupBy("root").agg(F.min("first").alias("first"))
    return rows.join(kept.select(F.col("first.row").alias("__row")), "__row", "left_semi").drop("__row")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
