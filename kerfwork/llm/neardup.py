"""Near-copy removal by SimHash, with an exact Jaccard check of word shingles.

Two texts link if the sets of their ``SHINGLE``-word shingles (64-bit hashes) have a
Jaccard similarity of ``SIMILAR`` or more; components of linked texts are the groups.

The sets' SimHash fingerprints have ``BITS`` bits, each 1 if it is set in over half of
the shingles' hashes. They are compared bit-sliced, a plane of 64 sets a word, with
counters from a tree of carry-save adders; those at ``RADIUS`` or fewer differing bits
link. At a similarity of 0.8 two large sets differ in 15% of the bits and the worst small
ones (four shingles of five) in 19%, so 80 of 256 lose a pair with probability 3e-7.

A radius that wide has no blocks of bits that linked fingerprints share, so which of
them meet is told by MinHash: ``BANDS`` keys of ``BAND`` minima each. A pair at 0.8
agrees on no key with probability (1 - 0.8**5)**32 = 3e-6, one above it with less.
Each bucket gives a star of edges, so no group is written as pairs. The fingerprints of
a component of these edges are compared with each other; then texts whose fingerprints
link are read again and compared exactly, one component of links at a time.

Only distinct sets are compared. Edge cases: null text counts as empty, and texts
without words are copies of each other; fewer words than a shingle make one shingle of
them all. Survivors are rows, not ids: of each group the row with the lowest id stays
(by hash of the text among equal ids), null ids last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerfwork.llm.common import broadcast_if_small, cut, map_texts, nothing_live, numbered, row_order, small_batches
from kerfwork.llm.simhash import components, planes, shingles

SHINGLE, SIMILAR = 5, 0.8
BITS, RADIUS = 256, 80
BANDS, BAND = 32, 5
#: Shingles hashed at once under all functions.
STEP = 2048
#: Rows of three numbers that are broadcast, so that texts need not be shuffled.
FEW = 500_000
_RNG = np.random.default_rng(10)
FLIP = _RNG.integers(0, 1 << 64, (BANDS * BAND, 1), np.uint64)
TIMES = _RNG.integers(0, 1 << 64, (BANDS * BAND, 1), np.uint64) | np.uint64(1)
MIX = _RNG.integers(0, 1 << 64, (BANDS, BAND), np.uint64) | np.uint64(1)
ADD = _RNG.integers(0, 1 << 64, BANDS, np.uint64)
SEED = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingles(text or "", SHINGLE))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * BAND, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, ((hashes[None, at : at + STEP] ^ FLIP) * TIMES).min(1), out=least)
    return (least.reshape(BANDS, BAND) * MIX).sum(1, dtype=np.uint64) + ADD


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``BITS`` bits of a set in words of 64, zero for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STEP):
        x = hashes[at : at + STEP, None] + SEED
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def counted(bits: np.ndarray) -> list[np.ndarray]:
    """Bitwise counters, lowest first, of how many planes (rows) have each lane's bit."""
    out = []
    while True:
        carries = []
        while len(bits) > 1:
            third = len(bits) // 3
            if third:  # full adders
                a, b, c = bits[:third], bits[third : 2 * third], bits[2 * third : 3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                bits = np.concatenate([half ^ c, bits[3 * third :]])
            else:
                carries.append(bits[:1] & bits[1:])
                bits = bits[:1] ^ bits[1:]
        out.append(bits[0])
        if not carries:
            return out
        bits = np.concatenate(carries)


def within(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Words of the lanes whose counter is ``radius`` or less."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in reversed(range(max(len(counters), radius.bit_length()))):
        c = counters[i] if i < len(counters) else np.zeros_like(above)
        if radius >> i & 1:
            equal &= c
        else:
            above |= equal & c
            equal &= ~c
    return ~above


def close(prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the fingerprints (n, words), the place of the first of its component.
    A search from each one looks only at words with lanes not reached yet."""
    n = len(prints)
    sliced = np.concatenate([planes(prints[:, k]) for k in range(prints.shape[1])])
    mine = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little").astype(bool)
    head = np.full(n, -1, np.int64)
    for first in range(n):
        if head[first] >= 0:
            continue
        head[first], todo = first, [first]
        while todo:
            i = todo.pop()
            left = np.flatnonzero(head < 0)
            if not len(left):
                break
            words = np.unique(left >> 6)
            lanes = sliced if len(words) == sliced.shape[1] else sliced[:, words]
            near = within(counted(np.where(mine[i][:, None], ~lanes, lanes)), radius)
            there = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
            hits = (words[there >> 6] << 6) + (there & 63)
            hits = hits[hits < n]
            hits = hits[head[hits] < 0]
            head[hits] = first
            todo += hits.tolist()
    return head


def linked(sets: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """For each of the sets, the place of the first of its component. A search from
    each set looks only at those not reached yet."""
    size = np.array(list(map(len, sets)), np.int64)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.zeros(0, np.int64)
    own = np.split(code, np.cumsum(size)[:-1])
    head = np.full(len(sets), -1, np.int64)

    def postings(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sets, bounds by code) of the shingles of the sets not reached."""
        of = np.repeat(left, size[left])
        codes = np.concatenate([own[i] for i in left])
        order = np.argsort(codes, kind="stable")
        return of[order], np.searchsorted(codes[order], np.arange(len(bounds)))

    bounds = np.zeros(int(code.max()) + 2 if len(code) else 1, np.int64)
    open_ = len(sets)
    held, bounds = postings(np.arange(len(sets)))
    at_build = open_
    for first in range(len(sets)):
        if head[first] >= 0:
            continue
        head[first], todo = first, [first]
        open_ -= 1
        while todo and open_:
            if open_ * 2 <= at_build:
                held, bounds = postings(np.flatnonzero(head < 0))
                at_build = open_
            i = todo.pop()
            begin, end = bounds[own[i]], bounds[own[i] + 1]
            n = end - begin
            shared = held[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            both = np.bincount(shared, minlength=len(sets))
            hits = np.flatnonzero((head < 0) & (both > 0) & (both >= similar * (size[i] + size - both) - 1e-9))
            head[hits] = first
            open_ -= len(hits)
            todo += hits.tolist()
    return head


def candidates(reps: DataFrame) -> DataFrame:
    """(a, b): for sets that share a key, the least of its bucket and themselves."""
    keyed = reps.select(F.explode("keys").alias("key"), "sig")
    least = keyed.groupBy("key").agg(F.min("sig").alias("a"), F.max("sig").alias("z")).where("a != z").select("key", "a")
    return keyed.join(least, "key").where("sig != a").select("a", F.col("sig").alias("b")).distinct()


def by_root(members: DataFrame, found, kind: str) -> DataFrame:
    """What ``found(sigs, values, rows)`` gives for each root of ``members`` (root, sig,
    value, __row), its rows in the order of sig."""
    small_batches(members.sparkSession)
    dealt = members.repartition("root").sortWithinPartitions("root", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_live()
        held, kept = None, ([], [], [])
        for batch in batches:
            for root, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if root != held and kept[0]:
                    yield found(*kept)
                    kept = ([], [], [])
                held = root
                for x, y in zip(kept, more, strict=True):
                    x.append(y)
        if kept[0]:
            yield found(*kept)

    return dealt.select("root", "sig", "value", "__row").mapInArrow(run, kind)


def sliced(members: DataFrame) -> DataFrame:
    """(root, sig, __row) of ``members`` whose fingerprint links to another's of their
    root, by the least sig of the links' component."""

    def found(sigs: list[int], prints: list[bytes], rows: list[int]) -> pa.RecordBatch:
        head = close(np.frombuffer(b"".join(prints), "<u8").reshape(len(prints), -1))
        more = np.bincount(head)[head] > 1
        names = np.array(sigs, np.int64)
        return pa.RecordBatch.from_pydict({"root": names[head[more]], "sig": names[more], "__row": np.array(rows, np.int64)[more]})

    return by_root(members, found, "root long, sig long, __row long")


def verified(members: DataFrame) -> DataFrame:
    """(sig, head) of ``members`` (value: hashes): the least of the linked sets."""

    def found(sigs: list[int], sets: list[bytes], _) -> pa.RecordBatch:
        names = np.array(sigs, np.int64)
        return pa.RecordBatch.from_pydict({"sig": names, "head": names[linked([np.frombuffer(s, "<u8") for s in sets])]})

    return by_root(members, found, "sig long, head long")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that aren't the first of their group."""
    rows = numbered(docs)

    def make():
        def work(texts: list) -> list[list]:
            sets = [shingle_set(t) for t in texts]
            return [[xxhash.xxh64_intdigest(s.tobytes(), 42) - (1 << 63) for s in sets], [band_keys(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets], [fingerprint(s).tobytes() for s in sets]]

        return work

    tagged = rows.select(row_order().alias("order"), "text")
    marked = cut(map_texts(tagged, ["order"], {"sig": "long", "keys": "array<long>", "print": "binary"}, make))
    reps = marked.select("sig", "keys").dropDuplicates(["sig"])
    loose = components(candidates(cut(reps)))
    best = cut(marked.groupBy("sig").agg(F.min("order").alias("first"), F.min("print").alias("print")))
    members = cut(sliced(loose.join(best, loose["node"] == best["sig"]).select("root", "sig", F.col("print").alias("value"), F.col("first.row").alias("__row"))))
    texts = rows.select("__row", "text").join(broadcast_if_small(members, members.count(), FEW), "__row")
    sets = map_texts(texts, ["root", "sig", "__row"], {"value": "binary"}, lambda: lambda some: [[shingle_set(t).tobytes() for t in some]])
    heads = cut(verified(sets)).select(F.col("sig").alias("__sig"), "head")
    kept = best.join(heads, best["sig"] == heads["__sig"], "left").groupBy(F.coalesce("head", "sig")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row"))
    gone = cut(marked.select(F.col("order.row").alias("__row")).join(kept, "__row", "left_anti"))
    return rows.join(broadcast_if_small(gone, gone.count(), 2 * FEW), "__row", "left_anti").drop("__row")
