"""Cutting of texts to pieces, against the tokenizers on whole texts."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from kerfwork.llm import bpe, pieces, tokenfile

BITS = ["a", "word", "Zoë", "ñandú", "don't", "'s", "'ll", "'", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "\u2028", "\x1c", ".", ",", "!?", "…", "12", "3", "\U0001f600", "中文", "×", "<|endoftext|>", "<|endof", "text|>", "_", "e\u0301", "ǆ", "ª", ""]


def _texts():
    rng = random.Random(5)
    made = ["".join(rng.choices(BITS, k=rng.randrange(1, 25))) for _ in range(3000)]
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    return [None, "", *made, *docs, "ab " * 400_000, "x" * 300_000]


def _check(ids_of, want, end=None):
    texts = _texts()
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        flat, bounds = ids_of.texts(pa.array(some, pa.string()), end)
        for text, a, b in zip(some, bounds[:-1], bounds[1:], strict=True):
            assert flat[a:b].tolist() == want(text or "") + ([] if end is None else [end]), (text or "")[:99]


def test_equals_library():
    path = P.path("byte_bpe_50k.json")
    fresh, ids_of = Tokenizer.from_file(path), tokenfile.library_ids(path)
    assert ids_of.encode.joins and ids_of.whole == ("<|endoftext|>",)
    _check(ids_of, lambda t: fresh.encode(t, add_special_tokens=False).ids, 2)
    flat, bounds = ids_of.texts(pa.array([], pa.string()), 2)
    assert len(flat) == 0 and bounds.tolist() == [0]


def test_equals_tiktoken():
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _check(pieces.PieceIds(bpe.ByteBpe(ranks, P.PATTERN).encode), own.encode_ordinary)


@pytest.mark.parametrize("kept", [3, 1_000_000])
def test_collisions_and_renewal_change_nothing(monkeypatch, kept):
    """With a hash that only adds bytes, anagrams collide."""
    monkeypatch.setattr(pieces, "POWERS", np.ones_like(pieces.POWERS))
    monkeypatch.setattr(pieces, "INVERSES", np.ones_like(pieces.INVERSES))
    monkeypatch.setattr(pieces, "KEPT", kept)
    path = P.path("byte_bpe_50k.json")
    fresh = Tokenizer.from_file(path)
    encoder = tokenfile.LibraryEncoder(path)
    ids_of = pieces.PieceIds(encoder, encoder.markers)
    texts = ["not ton onto", "onto ton not tno", "abc bca. cab"]
    for _ in range(2):
        flat, bounds = ids_of.texts(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_blocks_change_no_cut(monkeypatch):
    raw = np.frombuffer("".join(t or "" for t in _texts()[:1500]).encode(), np.uint8)
    whole = pieces.starts(raw)
    for block in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(pieces, "BLOCK", block)
        assert (pieces.starts(raw[:20_000]) == np.append(whole[:19_999], pieces.starts(raw[:20_000])[-1])).all()
