"""What the operators of this subpackage share.

Words are maximal runs of characters other than ``[\\x20\\x09-\\x0D]``; only A-Z are
lower-cased. In Python both are exactly ``bytes.lower().split()``.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfwork.ship import ship

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes in one Arrow batch of a Python operator, the same for all of them, as
#: plans built earlier run with the setting of the moment.
BATCH_ROWS, BATCH_BYTES = 500, 4_000_000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_bucket(doc_id: Column, buckets: int = 5) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % buckets


def small_batches(spark: SparkSession) -> None:
    """To be called by every operator that runs Python on the executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. Only a session on one machine may lack it and gets one of its own."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not configured and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="shared-"))
    return configured or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written to the shared folder and read back, with a column ``__row`` that
    names the row and stays the same in every later reading."""
    folder = f"{shared_dir(docs.sparkSession)}/rows-{uuid.uuid4().hex}"
    docs.withColumn("__row", F.monotonically_increasing_id()).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def row_order() -> Column:
    """Order of ``numbered`` rows: by id (null ids last), hash of the text, row."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("h"), F.col("__row").alias("row"))


#: A key is hot above so many rows, and above this part of all rows: hot keys are few.
HOT_ROWS, HOT_PART = 500, 20_000


def hot_limit(rows: int) -> int:
    """Rows above which a key is hot; at most ``HOT_PART`` keys are."""
    return max(HOT_ROWS, -(-rows // HOT_PART))


def join_hot(left: DataFrame, right: DataFrame, key: str, other: str, rows: int, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` (unique in ``other``) on key = other. Rows of ``left``
    (so many) with a hot key meet its row of ``right`` by a broadcast of at most
    ``HOT_PART`` rows, all others by a shuffle, so no task gets all rows of a key."""
    hot = cut(left.groupBy(F.col(key).alias("__key")).count().where(F.col("count") > hot_limit(rows)).select("__key"))
    if not hot.count():
        return left.join(right, F.col(key).eqNullSafe(F.col(other)), how)
    marked = left.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    few = right.join(F.broadcast(hot), F.col(other).eqNullSafe(F.col("__key")), "left_semi")
    by_broadcast = marked.where("__hot").drop("__hot").join(F.broadcast(few), F.col(key).eqNullSafe(F.col(other)), how)
    by_shuffle = marked.where("__hot IS NULL").drop("__hot").join(right, F.col(key).eqNullSafe(F.col(other)), how)
    return by_broadcast.unionByName(by_shuffle)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint if the counted rows are at most ``limit``; else the plain
    frame, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
#: Text bytes handed to a Python function at once (a longer single text goes alone).
PIECE_BYTES = 1_000_000


_LIVE: dict[str, object] = {}


def live(name: str, make: Callable[[], object]):
    """What this Python worker holds between tasks under a name. It holds one thing only:
    workers outlive the stages that used them, and their memory adds up."""
    if name not in _LIVE:
        nothing_live()
        _LIVE[name] = make()
    return _LIVE[name]


def nothing_live() -> None:
    """To be called first by tasks that hold nothing between them but much while they run."""
    _LIVE.clear()
    give_back()


def give_back() -> None:
    """Freed memory of this worker goes back to the machine, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``PIECE_BYTES`` bytes of the column ``text``."""
    size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        top = max(at + 1, int(np.searchsorted(size, done + PIECE_BYTES, "right")))
        yield batch.slice(at, top - at)
        at = top


def map_texts(docs: DataFrame, keep: list[str], added: dict[str, str], make: Callable[[], Callable[[list], list[list]]], arrow: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` and the ``added`` ones. ``make()`` runs once a
    task and returns a function from a list of texts (None for null; with ``arrow`` an
    Arrow array) to one list for each added column. The kept columns stay Arrow arrays, so nulls and 64-bit ids
    pass unchanged."""
    small_batches(docs.sparkSession)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {kind}" for c, kind in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not arrow:
            nothing_live()
        work = make()
        for batch in batches:
            for part in slices(batch, len(keep)):
                texts = part.column(len(keep))
                columns = work(texts if arrow else texts.to_pylist())
                arrays = [part.column(i) for i in range(len(keep))] + [pa.array(x, ARROW[kind]) for x, kind in zip(columns, added.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *added])
        del work
        give_back()

    return docs.select(*keep, "text").mapInArrow(run, schema)


class PairTable:
    """Open-addressing hash table from uint64 keys to int64 values, looked up for
    whole arrays at once. The key 2**64-1 is reserved."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.missing = missing
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        size = 1 << self.bits
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, self.EMPTY, np.uint64)
        self.values = np.full(size, missing, np.int64)
        keys, values = np.asarray(keys, np.uint64), np.asarray(values, np.int64)
        keys, first = np.unique(keys, return_index=True)
        values, slot = values[first], self._slot(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] == self.EMPTY
            order = np.flatnonzero(free)
            winners = order[np.unique(slot[order], return_index=True)[1]]
            self.keys[slot[winners]] = keys[winners]
            self.values[slot[winners]] = values[winners]
            rest = np.ones(len(keys), bool)
            rest[winners] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * self.MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        flat = np.ascontiguousarray(keys, np.uint64).ravel()
        slot = self._slot(flat)
        found = self.keys[slot]
        out = np.where(found == flat, self.values[slot], self.missing)
        open_ = np.flatnonzero((found != flat) & (found != self.EMPTY))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            there, want = self.keys[slot[open_]], flat[open_]
            hit = there == want
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != self.EMPTY)]
        return out.reshape(np.shape(keys))
