"""Token ids in flat binary files.

Documents are range-partitioned by id and sorted; partition p writes three files:
``p.ids`` (flat unsigned integers, 16 bits if the vocabulary allows, else 32),
``p.off`` (uint64 offsets of the documents in it, one more than documents) and
``p.doc`` (int64 document ids, ascending). The number of ids that precede a partition
comes from prefix sums over the partitions' counts, so no task waits for another.
Readers map the files into memory.

Files are written under a name of their own for each attempt and then renamed, so a
lost or repeated task leaves whole files with equal content. They lie in the shared
folder (``spark.checkpoint.dir``), which must be mounted as a path on every machine.

Edge cases: null text counts as empty and holds the end id alone; an empty table has
no files and no rows; rows with equal ids keep an order by text; null ids come first
and are stored as the least integer.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfwork.llm.common import live, shared_dir, slices, small_batches
from kerfwork.llm.pieces import PieceIds, in_order

#: Stands for a null id, which sorts first.
NULL_ID = -(1 << 63)
#: Words the library encodes in one call.
JOINED = 100
#: The characters that stand for bytes in a byte-level vocabulary: visible ones of
#: Latin-1 for themselves, the others for those from 256 on.
_VISIBLE = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
STANDS = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}
#: Up to here, letters are told alike by every version of the character tables.
LATIN = "\u024f"


class LibraryEncoder:
    """Encodes pieces by the tokenizers library. A piece that is one word, with a space
    in front or without, is one match of the library's pre-tokenizer, so its characters
    go to the library's model as they are. Many such words go in one call: behind their
    own spaces, or with line feeds between them; no token of the vocabulary goes on from
    a word of Latin letters to either, which is checked. All other pieces go to the whole
    tokenizer."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.loaded = Tokenizer.from_file(path)
        self.model, self.vocabulary = self.loaded.model, self.loaded.get_vocab_size()
        self.markers = tuple(t.content for t in self.loaded.get_added_tokens_decoder().values())
        names = self.loaded.get_vocab(with_added_tokens=False)
        self.space, self.feed = STANDS[0x20], STANDS[0x0A]
        letters = {STANDS[b] for b in range(256) if bytes([b]).isalpha() or 0x80 <= b <= 0xBF or 0xC3 <= b <= 0xC9}
        self.begins = np.zeros(self.vocabulary + 1, bool)
        self.begins[[i for token, i in names.items() if token.startswith(self.space)]] = True
        self.feed_id = names.get(self.feed, -1)
        plain = type(self.loaded.pre_tokenizer).__name__ == "ByteLevel" and self.loaded.normalizer is None and self.feed_id >= 0

        def spans(token: str, mark: str) -> bool:
            """Whether a token goes on from a word to the mark behind it."""
            return any(c == mark and letters.issuperset(word) for k, c in enumerate(token) if (word := token[:k].lstrip(self.space)))

        self.joins = plain and not any(spans(t, self.space) or spans(t, self.feed) or (self.feed in t[:-1] and t.rpartition(self.feed)[2][:1] in letters) for t in names)

    def word(self, core: bytes) -> str | None:
        """A word's characters for the model; null if it isn't surely one of letters."""
        if core.isalpha():
            return core.decode()
        text = core.decode()
        return core.decode("latin-1").translate(STANDS) if text.isalpha() and max(text) <= LATIN else None

    def __call__(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        after_space, bare, rest = ([], []), ([], []), []
        for i, piece in enumerate(pieces):
            spaced = piece[0] == 0x20
            word = self.word(piece[1:] if spaced else piece) if self.joins else None
            if word is None:
                rest.append(i)
            else:
                kind = after_space if spaced else bare
                kind[0].append(i)
                kind[1].append(word)
        ids, n = [], []
        for (_, words), between in ((after_space, self.space), (bare, self.feed)):
            for k in range(0, len(words), JOINED):
                some = words[k : k + JOINED]
                made = np.array([t.id for t in self.model.tokenize((between if words is after_space[1] else "") + between.join(some))], np.uint32)
                edges = np.flatnonzero(self.begins[made] if words is after_space[1] else made == self.feed_id)
                if words is bare[1]:
                    made, edges = np.delete(made, edges), np.concatenate([[0], edges - np.arange(len(edges))])
                if len(edges) != len(some):
                    raise RuntimeError("a token spans two words")
                ids.append(made)
                n.append(np.diff(edges, append=len(made)))
        _, made, counts = in_order([x.ids for x in self.loaded.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False)])
        return after_space[0] + bare[0] + rest, np.concatenate([*ids, made]), np.concatenate([*n, counts])


def library_ids(path: str) -> PieceIds:
    """The ids of whole texts by the tokenizers library, with the tokenizer as loaded."""

    def make() -> PieceIds:
        encoder = LibraryEncoder(path)
        return PieceIds(encoder, encoder.markers)

    return live(path, make)


def local_path(uri: str) -> str:
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"token files need a mounted shared folder, not {uri}")
    return parsed.path


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2) -> list[dict]:
    """Write the files of ``docs`` (doc_id, text) to ``folder``. Returns the manifest:
    part, base (ids before it), n_docs, n_ids, dtype, in document order."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_ids(path)
        kind = "<u2" if encoder.encode.vocabulary <= 1 << 16 else "<u4"
        part, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        stem = os.path.join(folder, f"{part:08d}")
        offsets, names, total = [np.zeros(1, np.int64)], [], 0
        out = None
        for batch in batches:
            if out is None:
                os.makedirs(folder, exist_ok=True)
                out = open(f"{stem}.ids.{mark}", "wb")  # noqa: SIM115
            for piece in slices(batch, 1):
                names.append(piece.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                ids, bounds = encoder.texts(piece.column(1), end_id)
                ids.astype(kind, copy=False).tofile(out)
                offsets.append(bounds[1:] + total)
                total += len(ids)
        if out is None:
            return
        out.close()
        np.concatenate(offsets).astype("<u8").tofile(f"{stem}.off.{mark}")
        np.concatenate(names).astype("<i8").tofile(f"{stem}.doc.{mark}")
        for x in ("ids", "off", "doc"):
            os.replace(f"{stem}.{x}.{mark}", f"{stem}.{x}")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [sum(map(len, names))], "n_ids": [total], "dtype": [kind]})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    counted = ordered.mapInArrow(run, "part long, n_docs long, n_ids long, dtype string").collect()  # a row a partition
    manifest, base = [], 0
    for row in sorted(counted, key=lambda r: r["part"]):
        manifest.append({"part": row["part"], "base": base, "n_docs": row["n_docs"], "n_ids": row["n_ids"], "dtype": row["dtype"]})
        base += row["n_ids"]
    return manifest


def read(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, base, kind in zip(pdf["part"], pdf["base"], pdf["dtype"], strict=True):
                stem = os.path.join(folder, f"{part:08d}")
                ids = np.memmap(f"{stem}.ids", kind, "r")
                offsets = np.memmap(f"{stem}.off", "<u8", "r").astype(np.int64)
                names = np.memmap(f"{stem}.doc", "<i8", "r")
                crc = [zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pd.DataFrame({"doc_id": pd.Series(np.array(names), dtype="Int64").mask(np.array(names) == NULL_ID), "start": base + offsets[:-1], "n_tokens": np.diff(offsets), "ids_crc32": crc})

    parts = spark.createDataFrame([(m["part"], m["base"], m["dtype"]) for m in manifest], "part long, base long, dtype string")
    return parts.repartition(len(manifest), F.col("part")).mapInPandas(run, schema)


def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(local_path(shared_dir(spark)), f"tokens-{uuid.uuid4().hex}")
    return read(spark, folder, write(docs, public_tokenizers.path("byte_bpe_50k.json"), folder))
