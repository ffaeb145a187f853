"""Ids of whole texts by their distinct pieces, whole Arrow batches at a time.

Texts are cut where one match of the pre-tokenizer's pattern ends and the next begins,
whatever stands farther off:

* before a space that a character follows which is surely no white space;
* between an ASCII letter and ASCII punctuation other than an apostrophe;
* between visible ASCII and a line feed, and after that line feed if it is the only
  white space there and a solid character follows.

Cuts are found on the bytes of a batch at once. Each piece has a polynomial hash, from
differences of one cumulative sum, by which its ids are looked up in an open-addressing
table; its bytes are then compared with those kept, so a collision costs time and no
result. Only pieces not met before go to the encoder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once. A piece above that goes to the encoder each time.
CHUNK = 1 << 18
#: Bytes that are searched for cuts at once.
BLOCK = 1 << 23
#: A worker's table: slots, and the pieces, ids and bytes above which it begins anew.
SLOT_BITS, KEPT, KEPT_IDS, KEPT_BYTES = 20, 500_000, 2_500_000, 8_000_000
PRIME = 0x9E3779B97F4A7C55
MIX = np.uint64(0xD6E8FEB86659FD93)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSES = _powers(PRIME), _powers(pow(PRIME, -1, 1 << 64))
COUNT = np.arange(CHUNK + 1, dtype=np.int32)

BYTE = np.arange(256)
_VISIBLE = (BYTE > 0x20) & (BYTE < 0x7F)
_LETTER = ((BYTE | 0x20) >= ord("a")) & ((BYTE | 0x20) <= ord("z"))
_MARK = _VISIBLE & ~_LETTER & ~((BYTE >= ord("0")) & (BYTE <= ord("9"))) & (BYTE != ord("'"))
#: Whether a byte begins a character that is no white space in any reading of the word.
_SOLID = _VISIBLE | ((BYTE >= 0xC3) & (BYTE <= 0xE0)) | ((BYTE >= 0xE4) & (BYTE <= 0xEE)) | ((BYTE >= 0xF0) & (BYTE <= 0xF4))
#: What a byte may do: begin a piece before a solid byte; end one before a mark or a
#: line feed; and the bits, shifted by 4, that the next byte must have for that.
TABLE = bytes(((BYTE == 0x20) * 1 | _LETTER * 2 | _VISIBLE * 4 | _SOLID * 16 | _MARK * 32 | (BYTE == 0x0A) * 64).astype(np.uint8))


def starts(raw: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte of ``raw``, its first aside. Blocks of bytes
    are looked at one after the other, with the two before and the one behind them."""
    out = np.zeros(len(raw), bool)
    for at in range(0, len(raw), BLOCK):
        low = max(0, at - 2)
        out[at : at + BLOCK] = _starts(raw[low : at + BLOCK + 1])[at - low : at - low + BLOCK]
    return out


def _starts(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw), bool)
    if len(raw) < 2:
        return out
    kinds = np.frombuffer(raw.tobytes().translate(TABLE), np.uint8)
    meet = kinds[:-1] & (kinds[1:] >> 4)  # 1: space and solid, 2: letter and mark, 4: visible and line feed
    out[:-1] = meet & 1
    out[1:] |= meet > 1
    out[2:] |= ((meet[:-1] & 4) & (kinds[2:] >> 2)) > 0
    return out


def plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of an array of strings, null as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, edges, data = texts.buffers()
    bounds = np.frombuffer(edges, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


class Growing:
    """An array that is added to at its end."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            wider = np.zeros(max(2 * len(self.held), self.n + len(more)), self.held.dtype)
            wider[: self.n] = self.held[: self.n]
            self.held = wider
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


class PieceIds:
    """``encode`` takes a list of pieces (bytes) and gives (order, ids, n): places in
    that list, the ids of all pieces in that order, and how many each has. Texts with one
    of the ``whole`` strings are not cut."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[list[int], np.ndarray, np.ndarray]], whole: tuple[str, ...] = ()):
        self.encode, self.whole = encode, whole
        self._clear()

    def _clear(self) -> None:
        self.keys, self.places = np.full(1 << SLOT_BITS, EMPTY), np.zeros(1 << SLOT_BITS, np.int32)
        self.id_begin, self.id_count, self.ids = Growing(np.int32), Growing(np.int32), Growing(np.uint32)
        self.byte_begin, self.byte_count, self.bytes = Growing(np.int32), Growing(np.int32), Growing(np.uint8)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it has none."""
        slot = ((keys * MIX) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.places[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there != EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << SLOT_BITS) - 1)
            there, want = self.keys[slot[open_]], keys[open_]
            hit = there == want
            out[open_[hit]] = self.places[slot[open_[hit]]]
            open_ = open_[~hit & (there != EMPTY)]
        return out

    def _insert(self, keys: np.ndarray, places: np.ndarray) -> None:
        """New keys, each once."""
        slot = ((keys * MIX) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == EMPTY)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[won]], self.places[slot[won]] = keys[won], places[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, places, slot = keys[rest], places[rest], (slot[rest] + 1) & ((1 << SLOT_BITS) - 1)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Places of new pieces, with their ids."""
        first = self.id_count.n
        order, ids, n = self.encode(pieces)
        placed = [pieces[k] for k in order]
        size = np.fromiter(map(len, placed), np.int64, len(placed))
        for begin, count, flat, size, more in ((self.id_begin, self.id_count, self.ids, n, ids), (self.byte_begin, self.byte_count, self.bytes, size, np.frombuffer(b"".join(placed), np.uint8))):
            begin.add(flat.n + np.cumsum(size) - size)
            count.add(size)
            flat.add(more)
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(first, first + len(order))
        return out

    def _places(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The place of each piece between ``edges`` of ``raw``."""
        begin, size = edges[:-1], np.diff(edges)
        whole = raw.tobytes()

        def taken(which: np.ndarray) -> list[bytes]:
            return [whole[a:b] for a, b in zip(begin[which].tolist(), edges[1:][which].tolist(), strict=True)]

        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(np.multiply(raw + np.uint64(1), POWERS[: len(raw)]), out=sums[1:])
        keys = (sums[edges[1:]] - sums[begin]) * INVERSES[begin]
        keys[keys == EMPTY] = 0
        at = self._find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, one = np.unique(keys[missing], return_index=True)
            self._insert(new, self._learn(taken(missing[one])))
            at[missing] = self._find(keys[missing])
        wrong = self.byte_count.held[at] != size
        kept = np.repeat(self.byte_begin.held[at] - begin, size)
        kept += COUNT[: len(raw)]
        differs = self.bytes.held.take(kept, mode="clip") != raw
        if wrong.any() or differs.any():  # pieces of equal hash
            wrong |= np.add.reduceat(differs, begin) > 0
            at[wrong] = self._learn(taken(np.flatnonzero(wrong)))
        return at

    def _chunks(self, raw: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        while at < len(edges) - 1:
            top = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK, "right")) - 1)
            yield raw[edges[at] : edges[top]], (edges[at : top + 1] - edges[at]).astype(np.int32)
            at = top

    def _found(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each piece has) of the pieces between ``edges`` of ``raw``."""
        if len(raw) > CHUNK:  # one long piece
            return self.encode([raw.tobytes()])[1:]
        if self.id_count.n > KEPT or self.ids.n > KEPT_IDS or self.bytes.n > KEPT_BYTES:
            self._clear()
        at = self._places(raw, edges)
        n = self.id_count.held[at]
        ends = np.cumsum(n)
        return self.ids.held[np.repeat(self.id_begin.held[at] - (ends - n).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)], n

    def texts(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of all texts, one after the other; with ``end`` each text's ids
        are followed by it."""
        raw, bounds = plain(texts)
        begins = np.append(starts(raw), True)
        for mark in self.whole:
            for i in np.flatnonzero(pc.match_substring(texts, mark).fill_null(False).to_numpy(zero_copy_only=False)):
                begins[bounds[i] : bounds[i + 1]] = False
        begins[bounds] = True
        edges = np.flatnonzero(begins)
        if not len(raw):
            edges = edges[:0]
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for part, inner in self._chunks(raw, edges):
            found, n = self._found(part, inner)
            ids.append(found)
            counts.append(n)
        flat, past = np.concatenate(ids), np.cumsum(np.concatenate(counts))
        out = past[np.searchsorted(edges, bounds)] if len(edges) else np.zeros(len(bounds), np.int64)
        if end is not None:
            flat, out = np.insert(flat, out[1:], np.uint32(end)), out + np.arange(len(out))
        return flat, out


def in_order(ids: list) -> tuple[range, np.ndarray, np.ndarray]:
    """What ``encode`` gives, from the ids of each piece in the pieces' order."""
    return range(len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
