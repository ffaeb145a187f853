"""Byte-level BPE encoding and decoding on padded matrices.

New pieces of text are put in length buckets and become the rows of a padded matrix
of token ids, one byte each at first. Each round every row merges its leftmost pair
of minimum rank: pair ranks come from a hashed lookup, the row closes its gap
(compaction), two pair ranks are looked up anew, and finished rows leave the matrix.
Pieces above ``LONGEST`` bytes, for which a matrix would need a round a byte over a
wide row, take the same merges in the same order from a heap.

Texts are cut where no token can span and the ids of their distinct pieces are kept
(see ``pieces``), so a piece is merged once in a while, not at each occurrence.

Edge cases: null text counts as empty and has no ids; the hash of no ids is that of
the empty string; texts of any length are whole; repeated rows encode alike.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from kerfwork.llm.common import PairTable, live, map_texts
from kerfwork.llm.pieces import PieceIds

LONGEST = 192
NONE = 1 << 40
class ByteBpe:
    """Ranks as {token bytes: rank}; a rank is the token's id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = PairTable(self._key(np.array(left), np.array(right)), np.array(merged), NONE)
        tokens = sorted((rank, token) for token, rank in ranks.items())
        size = np.zeros(tokens[-1][0] + 1, np.int64)
        for rank, token in tokens:
            size[rank] = len(token)
        self.size, self.begin = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(token for _, token in tokens), np.uint8)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        n = np.array([len(p) for p in pieces])
        width = int(n.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = self.byte_id[raw]
        rank = np.full((len(pieces), width), NONE)
        if width > 1:
            rank[:, :-1] = np.where(np.arange(1, width)[None, :] < n[:, None], self.pairs.get(self._key(ids[:, :-1], ids[:, 1:])), NONE)
        where, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(where):
            at = rank.argmin(1)
            row = np.arange(len(where))
            best = rank[row, at]
            ended = best >= NONE
            if ended.any():
                for i in np.flatnonzero(ended):
                    out[where[i]] = ids[i, : n[i]].astype("<u4")
                live = ~ended
                width = max(1, int(n[live].max())) if live.any() else 1
                ids, rank, n, where, at, best = ids[live, :width], rank[live, :width], n[live], where[live], at[live], best[live]
                if not len(where):
                    break
                row = np.arange(len(where))
            column = np.arange(width - 1)[None, :]
            later = column > at[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(later, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            ids[row, at] = best
            n = n - 1
            for place in (at - 1, at):
                ok = np.flatnonzero((place >= 0) & (place + 1 < n))
                there = place[ok]
                rank[ok, there] = self.pairs.get(self._key(ids[ok, there], ids[ok, there + 1]))
            last = np.flatnonzero(at + 1 >= n)
            rank[last, at[last]] = NONE
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = self.pairs.get(self._key(np.array(ids[:-1]), np.array(ids[1:])))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(found) if r < NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if y < n:
                    pair = (ids[x], ids[y])
                    if pair not in known:
                        known[pair] = int(self.pairs.get(self._key(np.array([pair[0]]), np.array([pair[1]])))[0])
                    if known[pair] < NONE:
                        heapq.heappush(heap, (known[pair], x, *pair))
        return np.array([x for x in ids if x >= 0], "<u4")

    def pieces(self, pieces: list[bytes]) -> dict[bytes, np.ndarray]:
        """The ids of each distinct piece."""
        out, by_size = {}, {}
        for p in set(pieces):
            if p in self.ranks:
                out[p] = np.array([self.ranks[p]], "<u4")
            elif len(p) > LONGEST:
                out[p] = self._long(p)
            else:
                by_size.setdefault((len(p) - 1).bit_length(), []).append(p)
        for power, group in by_size.items():
            step = max(1, 400_000 >> power)
            for at in range(0, len(group), step):
                out.update(zip(group[at : at + step], self._rows(group[at : at + step]), strict=True))
        return out

    def encode(self, pieces: list[bytes]) -> tuple[range, np.ndarray, np.ndarray]:
        """Ids of pieces of text (see ``PieceIds``), each match of the pattern on its own."""
        split = [[p] if p[p[:1] == b" " :].isalpha() else [m.encode() for m in self.pattern.findall(p.decode())] for p in pieces]
        ids = self.pieces([p for s in split for p in s])
        n = np.fromiter((sum(len(ids[p]) for p in s) for s in split), np.int64, len(split))
        return range(len(split)), np.concatenate([np.zeros(0, np.uint32), *[ids[p] for s in split for p in s]]).astype(np.uint32, copy=False), n

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        total = int(size.sum())
        shift = np.repeat(self.begin[ids] - (np.cumsum(size) - size), size)
        return self.bytes[shift + np.arange(total)].tobytes()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encode_ids(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_tokens, the ids as little-endian uint32 bytes, and hashes of
    the ids and of the bytes they decode to. One pass, so a task has one tokenizer."""

    def make():
        ids_of = live(f"{path} {pattern}", lambda: PieceIds(ByteBpe(load_ranks(path), pattern).encode))
        bpe = ids_of.encode.__self__
        names = [str(i) for i in range(len(bpe.size))]

        def work(texts: pa.Array) -> list[list]:
            n, raw, ids_hash, bytes_hash = [], [], [], []
            flat, bounds = ids_of.texts(texts)
            for begin, end in pairwise(bounds.tolist()):
                ids = flat[begin:end]
                n.append(len(ids))
                raw.append(ids.astype("<u4", copy=False).tobytes())
                ids_hash.append(hashlib.sha256(",".join(map(names.__getitem__, ids.tolist())).encode()).hexdigest())
                bytes_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return [n, raw, ids_hash, bytes_hash]

        return work

    return map_texts(docs, keep, {"n_tokens": "long", "ids": "binary", "ids_sha256": "string", "decoded_sha256": "string"}, make, arrow=True)


def encode_decode(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_tokens and hashes of the ids and of the bytes they decode to."""
    return encode_ids(docs, path, pattern, keep).drop("ids")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
